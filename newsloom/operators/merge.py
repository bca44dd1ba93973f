"""Upserts, deletes and retention as new snapshots: Parquet tables are never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], *newest: Column | str) -> DataFrame:
    """Of each key the row that comes last in the given order."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in newest])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def first_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the row that comes first: what dropDuplicates leaves open."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """By url_key: new title, press, category, time, raw text and quality; the longer body and summary; the rest stays as it was."""
    o, n = old.alias("o"), new.alias("n")
    has_old, has_new = F.col("o.url_key").isNotNull(), F.col("n.url_key").isNotNull()
    taken, longer = {"title", "press", "category", "published_at", "raw_summary", "summary_quality"}, {"body_text", "summary"}

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in taken:
            return F.when(has_new, b).otherwise(a).alias(c)
        if c in longer:
            return F.when(has_new & (~has_old | (F.length(b) > F.length(a))), b).otherwise(a).alias(c)
        return F.when(has_old, a).otherwise(b).alias(c)

    return o.join(n, F.col("o.url_key") == F.col("n.url_key"), "full_outer").select(*map(value, old.columns))


def fill_if_told(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of old replaced by those of new wherever these are not empty."""
    told = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(told, key, "left")
    return out.select(*[F.when(F.coalesce(F.col(f"_{c}"), F.lit("")) != "", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def popularity_live(log: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    return latest_per_key(log, ["url_key"], "arrival")


def popularity_backfill(log: DataFrame) -> DataFrame:
    """The best score and the best rank of each key."""
    return log.groupBy("url_key").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def popularity_archive(log: DataFrame) -> DataFrame:
    """The best score of each key; rank and source are those of its first entry."""
    return log.groupBy("url_key").agg(F.max("score").alias("score"), F.min_by("rank", "arrival").alias("rank"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    fresh = first_per_key(new, keys, *order) if order else new.dropDuplicates(keys)
    return old.unionByName(fresh.join(old, keys, "left_anti").select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def hide(saved: DataFrame, hidden: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved, hidden) after hiding a batch: hidden ones are no longer saved. Write both in one step."""
    keys = ["user_id", "url_key"]
    return delete_keys(saved, batch, keys), insert_or_ignore(hidden, batch, keys)


def rename_user(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of one user handed to another, who keeps their own."""
    moved = rows.filter(F.col("user_id") == old).withColumn("user_id", F.lit(new))
    return insert_or_ignore(rows.filter(F.col("user_id") != old), moved, ["user_id", "url_key"])


def delete_user(users: DataFrame, username: str) -> DataFrame:
    return users.withColumn("active", F.when(F.col("username") == username, 0).otherwise(F.col("active")))


def newest(rows: DataFrame, n: int, by: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(n)


def within_days(rows: DataFrame, time: str, now: str, days: int) -> DataFrame:
    return rows.filter(F.col(time) >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


def counters(deltas: DataFrame) -> DataFrame:
    """Final value of each key's clamped counter: the sum of its deltas less the lowest point that their running sum reached below 0."""
    so_far = F.sum("delta").over(Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    rows = deltas.withColumn("so_far", so_far).groupBy("key").agg(F.sum("delta").alias("total"), F.min("so_far").alias("lowest"))
    return rows.select("key", (F.col("total") - F.least(F.lit(0).cast("long"), "lowest")).alias("value"))


def cache_put(cache: DataFrame, history: DataFrame, category: str, payload: str, built_at: str) -> tuple[DataFrame, DataFrame]:
    """(cache, history): the old payload of the category goes to the history, the new one in its place."""
    old = cache.filter(F.col("category") == category).withColumn("backed_up_at", F.lit(built_at))
    new = cache.sparkSession.range(1).select(F.lit(category).alias("category"), F.lit(payload).alias("payload"), F.lit(built_at).alias("built_at"))
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = old.withColumn("id", F.lit(last + 1).cast("long")).select(*history.columns)
    return cache.filter(F.col("category") != category).unionByName(new), history.unionByName(added)


def cache_rollback(cache: DataFrame, history: DataFrame, category: str, now: str) -> tuple[DataFrame, DataFrame]:
    """The newest payload in the category's history goes back in place; without one nothing changes."""
    row = history.filter(F.col("category") == category).orderBy(F.desc("id")).select("payload").first()
    return (cache, history) if row is None else cache_put(cache, history, category, row[0], now)
