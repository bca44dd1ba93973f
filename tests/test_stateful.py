"""Streams with state: equal to plain folds whatever the micro-batches, and going on after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators.control import capped_per_day
from newsloom.streaming import stateful

T0 = datetime(2024, 1, 1)


def landed(spark, rows, schema, folder, n):
    """The rows, in order of time, as n files of one after the other."""
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


def read(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def in_two_runs(spark, rows, schema, tmp_path, make):
    """Half of the rows, a stop, the other half; three micro-batches each."""
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        landed(spark, part, schema, tmp_path / "in", 3)
        out = stateful.run_to_files(make(read(spark, schema, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return out.collect()


@pytest.fixture(scope="module")
def events():
    r = random.Random(6)
    at, out = T0, []
    for i in range(240):
        at += timedelta(minutes=r.randint(1, 90))
        out.append((i, r.choice(["a", "b", "c"]), at, r.random() < 0.05))
    return out


def test_cap(spark, events, tmp_path):
    schema = "id long, bucket string, ts timestamp, x boolean"
    got = in_two_runs(spark, events, schema, tmp_path, lambda s: stateful.publish_cap(s, 4))
    want = capped_per_day(spark.createDataFrame(events, schema), 4, "ts").select("id", "bucket", "kst_day", "place").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_gate(spark, events, tmp_path):
    r = random.Random(7)
    requests = [(i, f"u{r.randint(0, 15)}", at, published) for i, _, at, published in events]
    got = in_two_runs(spark, requests, "id long, url_key string, ts timestamp, published boolean", tmp_path, lambda s: stateful.retry_gate(s, tries=3, hours=20, late="1 hour"))
    state, want = {}, set()
    for i, key, at, published in requests:
        tries, last = state.get(key, (0, None))
        if published:
            state[key], what = (0, None), "published"
        elif tries >= 3:
            what = "spent"
        elif last and at < last + timedelta(hours=20):
            what = "held"
        else:
            state[key], what = (tries + 1, at), "tried"
        want.add((key, i, what, state.get(key, (0, None))[0]))
    assert {(r.url_key, r.id, r.what, r.tries) for r in got if r.id is not None} == want
    tried = {(r.url_key, r.ts + timedelta(hours=20)) for r in got if r.what == "tried"}
    due = [(r.url_key, r.ts) for r in got if r.what == "due"]
    assert due and set(due) <= tried and len(due) == len(set(due))


def test_cursors(spark, events, tmp_path):
    rows = events + [events[-1]]  # the last run is told twice
    got = in_two_runs(spark, rows, "id long, cursor string, ts timestamp, x boolean", tmp_path, stateful.cursors)
    assert len(got) == 241
    want = stateful.cursor_slots(spark.createDataFrame(events, "id long, cursor string, ts timestamp, x boolean")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "id long, bucket string, ts timestamp"
    for i, at in enumerate((T0, T0 + timedelta(days=9), T0 + timedelta(days=9, hours=1), T0)):
        spark.createDataFrame([(i, None, at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stateful.run_to_files(stateful.publish_cap(read(spark, schema, tmp_path / "in"), 4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r.id, r.place) for r in got.collect()) == [(0, 1), (1, 1), (2, 2)]
    assert got.filter(F.col("bucket").isNotNull()).count() == 0
