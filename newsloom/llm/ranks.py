"""Places in a total order, and sums of what stands before, with no task that sees all rows.

Rows are dealt out by ranges of the order and sorted within them; a row's place is its place in its range plus the sizes of the
ranges before. There is a range for each shuffle partition, so the sizes are a table of that many rows, whatever the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_PLACES = 33  # monotonically_increasing_id() has the partition above, and the place in it below, this bit


def _dealt(df: DataFrame, order: list, name: str) -> DataFrame:
    """df as a table with range_ and at_: the range of each row, and its place there from 0."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    return written(out.withColumn("range_", F.shiftright("at_", _PLACES)).withColumn("at_", F.col("at_").bitwiseAND(F.lit((1 << _PLACES) - 1))), name, free=False)


def _starts(dealt: DataFrame, weight: Column) -> DataFrame:
    """(range_, start_): the sum of weight over the ranges before. As many rows as there are shuffle partitions, which is what bounds the window."""
    size = dealt.groupBy("range_").agg(F.sum(weight).alias("n_"))
    return size.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("start_"))


def places(df: DataFrame, *order, name: str = "places") -> DataFrame:
    """df with position: each row's place, from 0, in the order of the columns told. Rows alike in all of them have places next to
    each other, in any order; end with a column that tells rows apart where many may be alike, so that one range need not hold all."""
    dealt = _dealt(df, list(order), name)
    starts = F.broadcast(_starts(dealt, F.lit(1)))
    return dealt.join(starts, "range_").select(*df.columns, (F.col("start_") + F.col("at_")).cast("long").alias("position"))


def sums_before(df: DataFrame, weight: str, *order, name: str = "sums") -> DataFrame:
    """df with before: the sum of weight over all rows before each, in the order of the columns told, which must tell rows apart."""
    dealt = _dealt(df, list(order), name)
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(_starts(dealt, F.col(weight)))
    return dealt.withColumn("in_", inside).join(starts, "range_").select(*df.columns, (F.col("start_") + F.col("in_")).cast("long").alias("before"))
