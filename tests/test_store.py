"""A store that batches change: what is touched, what comes again, and what goes down half-way."""

import pathlib

import pytest
from pyspark.sql import functions as F

from newsloom.operators import merge
from newsloom.sources.store import Store

SCHEMA = "k long, v string, at long"


def newest(old, new):
    return merge.latest_per_key(old.unionByName(new), ["k"], "at")


def counted(old, new):
    """Not to be done twice."""
    return old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"), F.sum("at").alias("at"))


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, ["k"], parts=8)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(store):
    return sorted(map(tuple, store.read().collect()))


def files(store):
    return {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in pathlib.Path(store.path).glob("part_=*/*.parquet")}


def test_upserts_touch_their_partitions_only(spark, store):
    assert held(store) == []
    store.apply(rows(spark, *[(i, "a", 1) for i in range(100)]), 0, newest)
    before = files(store)
    store.apply(rows(spark, (7, "b", 2), (7, "c", 3), (8, "old", 0)), 1, newest)
    after = files(store)
    assert held(store) == sorted([(i, "a", 1) for i in range(100) if i != 7] + [(7, "c", 3)])
    touched = {r[0] for r in rows(spark, (7, "", 0), (8, "", 0)).select(store.part()).collect()}
    part = lambda f: int(f.parent.name.removeprefix("part_="))
    assert {part(f) for f in before} == set(range(8)) and {f for f in before if after.get(f) == before[f]} == {f for f in before if part(f) not in touched}


def test_batches_that_come_again_change_nothing(spark, store):
    store.apply(rows(spark, (1, "a", 5), (2, "a", 5)), 0, counted)
    for _ in range(2):
        store.apply(rows(spark, (1, "b", 1), (3, "c", 1)), 1, counted)
    want = [(1, "b", 6), (2, "a", 5), (3, "c", 1)]
    assert held(store) == want
    store.apply(rows(spark, (1, "z", 100)), 0, counted)  # long done
    assert held(store) == want


def test_what_goes_down_half_way_is_made_good(spark, store):
    store.apply(rows(spark, (1, "a", 1), (2, "a", 1)), 0, counted)
    batch = rows(spark, (1, "b", 10), (5, "b", 10))
    store.stage(batch, 1, counted)  # and no more: nothing is seen of it yet
    assert held(store) == [(1, "a", 1), (2, "a", 1)]
    again = Store(spark, store.path, store.read().schema, ["k"], parts=8)
    again.apply(batch, 1, counted)
    again.apply(batch, 1, counted)
    assert held(again) == [(1, "b", 11), (2, "a", 1), (5, "b", 10)]

    def fails(old, new):
        return counted(old, new).withColumn("v", F.raise_error(F.lit("down")).cast("string"))

    with pytest.raises(Exception, match="down"):
        again.apply(batch, 2, fails)
    assert held(again) == [(1, "b", 11), (2, "a", 1), (5, "b", 10)]
    again.apply(batch, 2, counted)
    assert held(again) == [(1, "b", 21), (2, "a", 1), (5, "b", 20)]


def test_partitions_may_become_empty(spark, store):
    store.apply(rows(spark, *[(i, "a", i) for i in range(20)]), 0, newest)
    store.expire(F.col("at") < 15, 1)
    assert held(store) == [(i, "a", i) for i in range(15, 20)]
    store.expire(F.col("at") >= 0, 2)
    assert held(store) == []
    store.apply(rows(spark), 3, newest)
    store.apply(rows(spark, (None, None, None), (3, "n", 1)), 4, newest)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows(spark, (None, None, None), (3, "n", 1)).collect()))


def test_stream_with_a_restart(spark, store, tmp_path):
    def run(change):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store.sink(change)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        rows(spark, (1, "a", 1), (10 + i, "b", 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    applied = []

    def once(old, new):
        applied.append(1)
        return counted(old, new)

    write = store.apply

    def dies_after_the_second(batch, n, change):
        write(batch, n, change)
        if n == 1:
            raise RuntimeError("went down")

    store.apply = dies_after_the_second
    with pytest.raises(Exception, match="went down"):
        run(once)
    store.apply = write
    run(once)
    assert held(store) == [(1, "a", 3), (10, "b", 1), (11, "b", 1), (12, "b", 1)] and len(applied) == 3
