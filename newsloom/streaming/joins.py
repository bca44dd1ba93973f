"""Attempts against articles while both land: stream-stream outer joins with a watermark on each side.

A row waits for its other side as long as a time within the bound may still come, and goes out alone once neither can: state holds
twice the bound and what may be late, whatever the length of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITHIN = "40 days"  # times of an article and of its attempts are no farther apart
LATE = "2 days"
END = "\x04"  # the key of a row that ends a stream
#: Of what is joined, the rows that are no closing rows. It looks at both sides, so that Spark does not move it before the watermark,
#: which a closing row must reach; a null key would not reach it either, since Spark drops such rows before the join.
REAL = "NOT (coalesce(r_key, url_key) <=> char(4))"


def _outer(left: DataFrame, right: DataFrame, within: str, late: str) -> DataFrame:
    """Rows of left, with those of right (url_key, ts and others) of the same key within the bound, or with nulls; right's key and time become r_key, r_ts."""
    left = left.withWatermark("ts", late)
    right = right.withColumnsRenamed({"url_key": "r_key", "ts": "r_ts"}).withWatermark("r_ts", late)
    near = F.expr(f"url_key = r_key AND r_ts >= ts - interval {within} AND r_ts <= ts + interval {within}")
    return left.join(right, near, "left_outer")


def attempts_of_articles(articles: DataFrame, attempts: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """(id, attempts) of articles (id, url_key, ts), 0 for one of which no attempt landed. attempts: (url_key, attempts, ts), once a key,
    when it is settled; a key that lands twice gives two rows. Rows later than the watermark or without a time are dropped; an
    article without a key has no attempts. Closing rows give nothing."""
    both = _outer(articles.select("id", "url_key", "ts"), attempts.select("url_key", "attempts", "ts"), within, late)
    return both.filter(REAL).select("id", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


def attempts_not_done(attempts: DataFrame, done: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """(url_key, attempts) of attempts (url_key, attempts, ts) whose article is not among done (url_key, ts) within the bound: it is told
    when the article cannot come any more. Rows later than the watermark or without a time are dropped; those without a
    key have no article. Closing rows give nothing."""
    both = _outer(attempts.select("url_key", "attempts", "ts"), done.select("url_key", "ts"), within, late)
    return both.filter(REAL).filter("r_key is null").select("url_key", "attempts")


def closing_row(rows: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """The row that ends a stream of rows with url_key and ts: nulls, END as the key, and a time past which nothing waits. No rows: one all the same."""
    last = F.coalesce(F.max("ts"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    known = {"ts": (last + F.expr(f"2 * interval {within} + 2 * interval {late}")), "url_key": F.lit(END)}
    ends = rows.agg(*[c.alias(k) for k, c in known.items()])
    return ends.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def run_out(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All rows that are due, written to path and read back. Unlike a trigger that ends with the input this one goes on, without
    rows, when the last ones have moved the watermark, so that what waits for that comes out."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
