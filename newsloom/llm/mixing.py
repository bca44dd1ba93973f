"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket; the budget threshold of a source lies in one bucket,
and only documents of that bucket are looked at again, with the next bits of the hash, until the
threshold is a single hash value. Rows are then kept by a plain filter: nothing is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, pick, table, written

BITS, LEVELS = 12, 4  # 48 bits of the hash in four steps
#: Up to so many sources the table of thresholds (some 60 bytes each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def _hash() -> Column:
    """48 bits of the id's md5. Repeated ids share a value, so they are taken or left together."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def sizes_of(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, key (source with null made distinct), size in words, h; with carry also rest, a struct of the whole row."""
    d = (carried if carry else pick)(docs, "doc_id", "text", "source")
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")
    return d.select(*["rest"] * carry, "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size"), _hash().alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """key, source_size, target of each source. Sorted by code point (null last), sources weigh weights in turn, share
    the total of all sizes by weight, and stop at most times their size; the excess goes to the others by weight.

    A row per source, so the windows without partition see as many rows as there are sources."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    everything = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)).withColumn("rank", F.row_number().over(order))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("rank", "level"))).over(everything)["level"])
    return per.select("key", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """goal with whole (times each document is taken) and below: documents with a hash under it are taken once more.

    Documents are added in order of hash as long as their sum stays within the budget that is left."""
    small = F.broadcast if few else (lambda x: x)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.withColumn("whole", ratio.cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.lit(True))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        at = F.shiftright("h", shift)
        near = sizes.select("key", "size", "h").join(small(state.filter("open").select("key", "prefix")), "key").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = near.groupBy("key", at.alias("bucket")).agg(F.sum("size").alias("n"))
        run = hist.join(small(state.select("key", "left")), "key").withColumn("cum", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))
        edge = run.filter(F.col("cum") > F.col("left")).groupBy("key").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("n")).alias("used"))).alias("edge"))
        state = written(
            state.join(edge, "key", "left").select(
                "key", "source_size", "target", "whole",
                (F.col("left") - F.coalesce(F.col("edge.used"), F.lit(0))).alias("left"),
                F.when(F.col("edge").isNotNull(), F.col("edge.bucket")).otherwise(F.lit(0)).cast("long").alias("prefix"),
                (F.col("open") & F.col("edge").isNotNull()).alias("open"),
            ),
            f"mix-{level}",
            free=False,
        )
    return state.select("key", "source_size", "target", "whole", F.when(F.col("open"), F.col("prefix")).otherwise(F.lit(1 << BITS * LEVELS)).alias("below"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, times, taken; with carry also rest, a struct of the whole row.

    Null text: size 0. Null source: a source of its own, last in order. Repeated rows count each time and are taken alike.
    An empty table gives an empty result; if all sizes are 0, all targets are 0. Other columns are not looked at."""
    sizes = written(sizes_of(docs), "mix-sizes")
    goal = written(targets(sizes, weights, most), "mix-targets")
    few = goal.count() <= BROADCAST_SOURCES
    bound = thresholds(sizes, goal, few)
    out = (sizes_of(docs, carry) if carry else sizes).join(F.broadcast(bound) if few else bound, "key")
    times = F.col("whole") + F.when((F.col("whole") < most) & (F.col("h") < F.col("below")), 1).otherwise(0)
    return out.select(*["rest"] * carry, "doc_id", "source", "size", "source_size", "target", times.cast("long").alias("times"), (F.col("size") * times).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SIZES_SQL = r"""
sized AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM {docs}),
per AS (SELECT key, source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY key, source),
levels AS (SELECT *, 3 * source_size AS cap, row_number() OVER o AS rank,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * source_size / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM per WINDOW o AS (ORDER BY 3 * source_size / w, key)),
goal AS (SELECT key, source_size, least(w * (SELECT arg_min(level, rank) FROM levels WHERE level <= cap / w), cap::DOUBLE) AS target FROM levels),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal),
summed AS (SELECT s.*, b.source_size, b.target, b.whole, sum(size) OVER (PARTITION BY s.key ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM sized s JOIN budget b ON s.key = b.key),
mixed AS (SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN whole < 3 AND upto <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed)"""

ORACLE = {"op7_mixing": "WITH " + SIZES_SQL.format(docs="documents").strip() + "\nSELECT doc_id, size, source_size, target, taken FROM mixed"}
QUERIES = {"op7_mixing": op7_mixing}
