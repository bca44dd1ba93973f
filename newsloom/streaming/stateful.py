"""What runs keep between them, as state of streams: the day's publishing cap, the retry gate and the cursors.

Each gives, when rows come in order of their time, what its batch form gives. The rows of a key that come in one micro-batch meet
in one task, but in cursors_to_files(); maxFilesPerTrigger bounds them. State is in RocksDB, which keeps it on disk and not in the executor's heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.times import korea_day

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRIES, HOURS = 6, 20


def with_rocks(spark: SparkSession) -> SparkSession:
    """State with timers needs this store; it is the session's from here on, as Spark reads it when a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _ordered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(frames))
    return rows.sort_values(["ts", "id"]).itertuples(index=False)


def _ms(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


# --- the publishing cap ---------------------------------------------------------------------------------


class Cap(StatefulProcessor):
    """Key (bucket, day). The count of a day goes by a timer, once the watermark is past the day's end."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        first: list[tuple] = []
        for frame in rows:  # no more of a frame than may still be published
            first = heapq.nsmallest(self.cap - n, [*first, *zip(frame["ts"], frame["id"], strict=True)]) if n < self.cap else []
        if not self.count.exists():
            day = datetime.strptime(key[1], "%Y-%m-%d").replace(tzinfo=timezone(timedelta(hours=9)))
            self.handle.registerTimer(int((day + timedelta(days=1)).timestamp() * 1000))
        self.count.update((n + len(first),))
        yield pd.DataFrame([(i, key[0], key[1], n + k + 1) for k, (_, i) in enumerate(first)], columns=["id", "bucket", "kst_day", "place"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield pd.DataFrame([], columns=["id", "bucket", "kst_day", "place"])


def publish_cap(articles: DataFrame, cap: int = fixed.PUBLISH_CAP, late: str = "2 days") -> DataFrame:
    """(id, bucket, kst_day, place): the first cap articles (id, bucket, ts) of each bucket and Korean day, in order of arrival;
    within a micro-batch, of ts and id. Articles later than the watermark are not published. Null buckets are one bucket."""
    with_rocks(articles.sparkSession)
    dated = articles.select("id", "bucket", "ts").withWatermark("ts", late).withColumn("kst_day", korea_day(F.col("ts")))
    return dated.groupBy("bucket", "kst_day").transformWithStateInPandas(Cap(cap), "id long, bucket string, kst_day string, place int", "append", "eventTime")


# --- the retry gate -------------------------------------------------------------------------------------


class Gate(StatefulProcessor):
    """Key: an article. Its tries and the time of the last one; a timer tells when the next one is due."""

    def __init__(self, tries: int, hours: int):
        self.tries, self.pause = tries, hours * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "tries int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tries, last = self.done.get() if self.done.exists() else (0, None)
        out = []
        for r in _ordered(rows):
            if r.published:
                tries, last, what = 0, None, "published"
            elif tries >= self.tries:
                what = "spent"
            elif last is not None and _ms(r.ts) - last < self.pause:
                what = "held"
            else:
                tries, last, what = tries + 1, _ms(r.ts), "tried"
            out.append((key[0], r.id, r.ts, what, tries))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is None:
            self.done.clear()
        else:
            self.done.update((tries, last))
            if tries < self.tries:
                self.handle.registerTimer(last + self.pause)
        yield pd.DataFrame(out, columns=["url_key", "id", "ts", "what", "tries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], None, at, "due", self.done.get()[0])], columns=["url_key", "id", "ts", "what", "tries"]).astype({"id": "Int64"})


GATE = "url_key string, id long, ts timestamp, what string, tries int"


def retry_gate(requests: DataFrame, tries: int = TRIES, hours: int = HOURS, late: str = "2 days") -> DataFrame:
    """(url_key, id, ts, what, tries) of requests (url_key, id, ts, published): 'tried' up to tries times, at least so many hours after
    the last try, else 'held' or 'spent'; 'published' ends the count. Without an id: 'due', when the watermark has reached the time
    from which an article may be tried again. Requests later than the watermark are left out."""
    with_rocks(requests.sparkSession)
    rows = requests.select("url_key", "id", "ts", "published").withWatermark("ts", late)
    return rows.groupBy("url_key").transformWithStateInPandas(Gate(tries, hours), GATE, "append", "eventTime")


# --- cursors --------------------------------------------------------------------------------------------


class Cursor(StatefulProcessor):
    """Key: a cursor. The next slot, and the slots of runs seen lately, so that a run told twice keeps its own; a timer lets go of
    those that are keep_hours behind the watermark. They are a list, read and added to at once: a map is asked row by row."""

    def __init__(self, keep_hours: int):
        self.keep = keep_hours * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "slot long")
        self.runs = handle.getListState("runs", "id long, slot long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot, new, out = self.next.get()[0] if self.next.exists() else 0, [], []
        seen = {i: s for i, s, _ in self.runs.get()}
        if not seen:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.keep)
        for r in _ordered(rows):
            if r.id not in seen:
                new.append((r.id, slot, _ms(r.ts)))
                seen[r.id], slot = slot, slot + 1
            out.append((key[0], r.id, seen[r.id]))
        if new:
            self.runs.appendList(new)
            self.next.update((slot,))
        yield pd.DataFrame(out, columns=["cursor", "id", "slot"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if fresh := [r for r in self.runs.get() if r[2] > now - self.keep]:
            self.runs.put([tuple(r) for r in fresh])
            self.handle.registerTimer(now + self.keep)
        else:
            self.runs.clear()
        yield pd.DataFrame([], columns=["cursor", "id", "slot"])


def cursors(runs: DataFrame, keep_hours: int = 48, late: str = "2 days") -> DataFrame:
    """(cursor, id, slot): the turn of each run (cursor, id, ts), from 0. A run told again has the slot it had, for keep_hours at
    least. Runs later than the watermark are left out."""
    with_rocks(runs.sparkSession)
    rows = runs.select("cursor", "id", "ts").withWatermark("ts", late)
    return rows.groupBy("cursor").transformWithStateInPandas(Cursor(keep_hours), "cursor string, id long, slot long", "append", "eventTime")


def cursor_slots(runs: DataFrame) -> DataFrame:
    """cursors() of a table."""
    return runs.select("cursor", "id", (F.row_number().over(Window.partitionBy("cursor").orderBy("ts", "id")) - 1).cast("long").alias("slot"))


SEEN = "kind string, cursor string, id long, slot long, at timestamp"
TURNS = "cursor string, id long, slot long"


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not there yet
        return spark.createDataFrame([], schema)


def _met(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b by columns that may be null; b's are left out."""
    b = b.withColumnsRenamed({c: f"{c}_" for c in by})
    return a.join(b, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]), how).drop(*[f"{c}_" for c in by])


def _in_turn(new: DataFrame, after: DataFrame, path: str) -> DataFrame:
    """new (cursor, id, at), each different, with slot: its place in its cursor by time and id, from the cursor's slot in after on. Rows are
    dealt to ranges of (cursor, time, id), so that a cursor with most of the runs is in many tasks; only sizes of ranges are summed."""
    spark, order = new.sparkSession, ["cursor", "at", "id"]
    dealt = new.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
    dealt.write.mode("overwrite").parquet(path)  # what is read back has the same ranges each time
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = Window.partitionBy("cursor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = dealt.groupBy("cursor", "part").agg(F.count("*").alias("size"), F.min("n").alias("low"))
    size = size.select("cursor", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).alias("start"))
    size = _met(size, after, ["cursor"], "left").select("cursor", "part", (F.col("start") + F.coalesce("slot", F.lit(0))).alias("start"))
    return _met(dealt, size, ["cursor", "part"]).select("cursor", "id", "at", (F.col("n") + F.col("start")).alias("slot"))


def cursors_to_files(runs: DataFrame, path: str, checkpoint: str, keep_hours: int = 48, late: str = "2 days") -> DataFrame:
    """What cursors() gives, run to the end of what is there now, as Parquet files, for micro-batches and cursors of any size: no cursor is
    a group of one task. What it keeps between micro-batches is a table beside its rows, in two copies in turn, so that a
    micro-batch that comes again finds what the one before left. Runs without a time come last; they are remembered as the last ones are."""
    spark = runs.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        old = _there(spark, f"{path}/_seen/{(n - 1) % 2}", SEEN) if n else spark.createDataFrame([], SEEN)
        most = old.filter("kind = 'top'").select(F.unix_micros("at")).first()
        top = most[0] if most else None
        rows = batch.select("cursor", "id", F.col("ts").cast("timestamp").alias("ts"))
        if top is not None:
            rows = rows.filter(F.col("ts").isNull() | (F.col("ts") > F.timestamp_micros(F.lit(top)) - F.expr(f"interval {late}")))
        last = rows.agg(F.unix_micros(F.max("ts"))).first()[0]
        now = max((x for x in (top, last) if x is not None), default=0)
        seen = old.filter("kind = 'run'").select("cursor", "id", "slot", "at")
        at = F.min(F.coalesce("ts", F.timestamp_micros(F.lit(now + 1)))).alias("at")
        new = rows.groupBy("cursor", "id").agg(at)
        new = _met(new, seen.select("cursor", "id"), ["cursor", "id"], "left_anti")
        after = old.filter("kind = 'next'").select("cursor", "slot")
        new = _in_turn(new, after, f"{path}/_turns")
        known = seen.unionByName(new)
        told = _met(rows, known, ["cursor", "id"]).select("cursor", "id", "slot")
        told.write.mode("overwrite").parquet(f"{path}/batch={n}")
        fresh = known.filter(F.col("at") > F.timestamp_micros(F.lit(now)) - F.expr(f"interval {late}") - F.expr(f"interval {keep_hours} hours"))
        nexts = after.unionByName(new.select("cursor", (F.col("slot") + 1).alias("slot"))).groupBy("cursor").agg(F.max("slot").alias("slot"))
        state = fresh.withColumn("kind", F.lit("run")).unionByName(nexts.withColumn("kind", F.lit("next")), allowMissingColumns=True)
        state = state.unionByName(spark.range(1).select(F.lit("top").alias("kind"), F.timestamp_micros(F.lit(now)).alias("at")), allowMissingColumns=True)
        state.select("kind", "cursor", "id", "slot", "at").write.mode("overwrite").parquet(f"{path}/_seen/{n % 2}")

    query = runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return _there(spark, path, f"{TURNS}, batch int").drop("batch")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, as Parquet files: what came before a restart stays, what comes after is added."""
    query = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
