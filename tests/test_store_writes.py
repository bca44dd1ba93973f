"""A store writes a batch once, and moves its rows once."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import merge
from newsloom.sources.store import Store

ARTICLE = "url_key string, id long, title string, press string, category string, published_at string, raw_summary string, summary_quality string, body_text string, summary string"


def articles(spark, ids, body):
    return spark.range(max(ids) + 1).filter(F.col("id").isin(ids)).select(F.concat(F.lit("k"), "id").alias("url_key"), "id", *[F.lit(body).alias(c) for c in [x.split()[0] for x in ARTICLE.split(", ")][2:]])


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), spark.createDataFrame([], ARTICLE).schema, ["url_key"], parts=4)


def test_a_part_is_in_one_task(spark, store):
    rows = store._dealt(articles(spark, list(range(200)), "x")).select(F.spark_partition_id().alias("task"), store.part().alias("part")).distinct().collect()
    assert {r.part for r in rows} == set(range(4)) and len({r.task for r in rows}) == len(rows)


def test_a_batch_is_moved_and_not_written_again(spark, store, monkeypatch):
    for n, (ids, body) in enumerate((([1, 2, 3, 4, 5], "a"), ([4, 5, 6], "bb"))):
        store.apply(articles(spark, ids, body), n, merge.upsert_articles)
    assert sorted((r.id, r.body_text) for r in store.read().collect()) == [(1, "a"), (2, "a"), (3, "a"), (4, "bb"), (5, "bb"), (6, "bb")]
    left = spark._jvm.java.io.File(f"{store.path}/_stage/1").list()
    assert not [x for x in left if x.startswith("part_=")]


def test_a_writer_that_goes_down_between_two_moves(spark, store):
    store.apply(articles(spark, list(range(20)), "a"), 0, merge.upsert_articles)
    batch = articles(spark, list(range(20)), "bb")
    store.stage(batch, 1, merge.upsert_articles)
    file = spark._jvm.java.io.File
    first = sorted(x for x in file(f"{store.path}/_stage/1").list() if x.startswith("part_="))
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(store.path)
    one = path.getFileSystem(spark._jsc.hadoopConfiguration())
    one.delete(fs.Path(path, first[0]), True)
    one.rename(fs.Path(f"{store.path}/_stage/1/{first[0]}"), fs.Path(path, first[0]))  # one is moved,
    one.delete(fs.Path(path, first[1]), True)  # and one only taken away
    store.apply(batch, 1, merge.upsert_articles)
    assert sorted((r.id, r.body_text) for r in store.read().collect()) == [(i, "bb") for i in range(20)]


def test_a_join_on_the_keys_moves_rows_once(spark, store):
    old, new = (store._dealt(articles(spark, list(range(40)), x)) for x in "ab")
    plan = merge.upsert_articles(old, new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
