"""Cursors of any size: turns as those of cursors(), whatever the micro-batches, and no cursor in one task."""

from datetime import timedelta

from pyspark.sql import functions as F
from test_stateful import T0, landed, read

from newsloom.streaming import stateful

SCHEMA = "id long, cursor string, ts timestamp"


def test_turns_over_batches_restarts_and_repeats(spark, tmp_path):
    runs = [(i, (None, "a", "b")[i * i % 3], T0 + timedelta(minutes=30 * i)) for i in range(240)]
    rows = runs[:120] + [runs[100]] + runs[120:] + [runs[-1], runs[-1]]
    for part in (rows[:121], rows[121:]):
        landed(spark, part, SCHEMA, tmp_path / "in", 3)
        got = stateful.cursors_to_files(read(spark, SCHEMA, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = {tuple(r) for r in stateful.cursor_slots(spark.createDataFrame(runs, SCHEMA)).collect()}
    got = list(map(tuple, got.collect()))
    assert len(got) == 243 and set(got) == want


def test_late_runs_are_left_out(spark, tmp_path):
    for i, at in enumerate((T0, T0 + timedelta(days=9), T0 + timedelta(days=9, hours=1), T0)):
        spark.createDataFrame([(i, "a", at)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stateful.cursors_to_files(read(spark, SCHEMA, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r.id, r.slot) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_one_cursor_is_dealt_to_many_tasks(spark, tmp_path):
    runs = spark.range(2000).select(F.col("id"), F.lit("a").alias("cursor"), F.timestamp_seconds(F.col("id") % 700).alias("at"))
    got = stateful._in_turn(runs, spark.createDataFrame([("a", 5)], "cursor string, slot long"), str(tmp_path / "turns"))
    parts = spark.read.parquet(str(tmp_path / "turns")).groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2000
    assert [(r.at.timestamp(), r.id) for r in got.orderBy("slot").collect()] == sorted((i % 700, i) for i in range(2000))
    assert [r.slot for r in got.orderBy("slot").collect()] == list(range(5, 2005))
