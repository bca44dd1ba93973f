"""A keyed table that batches change in place: only the partitions that a batch touches are written anew.

Rows are dealt to partitions by a hash of their key. A batch is first merged with its partitions' rows into a stage, and marked as
staged; then the folders of the stage are moved to the place of the partitions. A batch that comes again, because a stream or a driver
went down, either finds what is left of its stage, and moves that, or no mark, and then has changed nothing yet. So a batch counts
once, whatever it does: sums of counters too. Batches have ascending numbers, as those of foreachBatch have; one writer at a time.

Replacing a partition with no rows would leave the old ones, so each partition that was ever touched holds a row that is no data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """path: a folder of its own. keys: what tells rows apart. parts: partitions, fixed for good; a batch of few keys touches as many
    at most, so that more partitions mean less to write for a small batch and more files in all."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts, self.columns = spark, path.rstrip("/"), keys, parts, schema.fieldNames()
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("mark_", T.BooleanType()), T.StructField("part_", T.IntegerType())])

    def part(self) -> Column:
        """By the hash that repartition() deals rows with, so that what is dealt by the keys to a multiple of parts is in one part a task."""
        return F.pmod(F.hash(*self.keys), F.lit(self.parts)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Both sides of a change are dealt alike: a join or window on the keys moves no row again, nor does the write."""
        each = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)
        return rows.repartition(each * self.parts, *self.keys)

    def _read(self, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(path)
        except AnalysisException:  # not there yet
            return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.path).filter("mark_ is null").select(*self.columns)

    def _staged(self, n: int) -> str:
        """Two stages in turn: that of the last batch is kept until the next but one is staged."""
        return f"{self.path}/_stage/{n % 2}"  # readers pass over names with an underscore

    def _last(self) -> int:
        """The number of the last batch that was staged."""
        found = [-1]
        for k in (0, 1):
            try:
                found += [r["n"] for r in self.spark.read.schema("n long").parquet(f"{self._staged(k)}-done").collect()]
            except AnalysisException:
                pass
        return max(found)

    def _tell(self, n: int) -> None:
        self.spark.range(1).select(F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self._staged(n)}-done")

    def stage(self, batch: DataFrame, n: int, change: Change) -> None:
        """Merges the batch with the rows of the partitions it touches."""
        touched = [r[0] for r in batch.select(self.part().alias("p")).distinct().collect()]  # parts numbers at most
        old = self._read(self.path).filter(F.col("part_").isin(touched) & F.col("mark_").isNull()).select(*self.columns)
        rows = change(self._dealt(old), self._dealt(batch)).select(*self.columns, F.lit(None).cast("boolean").alias("mark_"), self.part().alias("part_"))
        none = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]
        marks = self.spark.createDataFrame([(p,) for p in touched], "part_ int").select(*none, F.lit(True).alias("mark_"), "part_")
        rows.unionByName(marks).write.mode("overwrite").option("compression", "zstd").partitionBy("part_").parquet(self._staged(n))
        self._tell(n)

    def _publish(self, n: int) -> None:
        """What is still in the stage takes the place of its partitions. Folders are moved, not written again; those that were moved before
        the writer went down are not in the stage any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path
        stage = folder(self._staged(n))
        fs = stage.getFileSystem(conf)
        for one in fs.listStatus(stage) if fs.exists(stage) else []:
            if one.getPath().getName().startswith("part_="):
                to = folder(self.path, one.getPath().getName())
                fs.delete(to, True)
                if not fs.rename(one.getPath(), to):
                    raise OSError(f"{one.getPath()} could not be moved to {to}")

    def apply(self, batch: DataFrame, n: int, change: Change) -> None:
        """change(rows of the touched partitions, batch) takes the place of these rows. The keys of what it returns are those of
        either side. A batch number that comes again changes nothing more, whatever the batch then holds."""
        last = self._last()
        if n < last:
            return  # later ones have been applied over it
        if n > last:
            self.stage(batch, n, change)
        self._publish(n)

    def expire(self, gone: Column, n: int) -> None:
        """Removes rows, as a batch of its own number; only partitions that hold some of them are touched."""
        self.apply(self.read().filter(gone), n, lambda old, _: old.filter(~F.coalesce(gone, F.lit(False))))

    def sink(self, change: Change) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. The batch is kept while it is merged, as it is read twice."""

        def write(batch: DataFrame, n: int) -> None:
            batch.persist()
            try:
                self.apply(batch, n, change)
            finally:
                batch.unpersist()

        return write
