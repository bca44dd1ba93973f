"""The stateful parts as Structured Streaming: each gives, at the end of its input, what the batch operator gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import HostLedger


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as they land; timestamps without zone are UTC."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Counts and sums by Korean day: days start at 15:00 UTC. Rows later than the watermark are dropped."""
    day = F.window("ts", "1 day", "1 day", "15 hours")
    totals = events.withWatermark("ts", late).groupBy(day).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return totals.select(F.date_format(F.from_utc_timestamp("window.start", "Asia/Seoul"), "yyyy-MM-dd").alias("kst_day"), "n", "total")


def seen_once(events: DataFrame, key: str = "url_key", late: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def host_health(attempts: DataFrame, forget: str = "2 days") -> DataFrame:
    """(host, id, fails, skipped) of attempts (host, ts, id, ok, status): the ledger of each host is its state, forgotten once the
    watermark is two days past its last attempt."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger = HostLedger()
        if state.exists:
            fail, at = state.get
            if fail:
                ledger.hosts[key[0]] = [fail, at]
        out, t = [], 0.0
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            t = r.ts.timestamp()
            skipped = ledger.closed(key[0], t)
            if not skipped:
                ledger.record(key[0], bool(r.ok), r.status, t)
            out.append((key[0], r.id, ledger.hosts.get(key[0], [0])[0], skipped))
        fail, at = ledger.hosts.get(key[0], (0, 0.0))
        state.update((fail, at))
        state.setTimeoutTimestamp(max(int(t * 1000) + 48 * 3600 * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["host", "id", "fails", "skipped"])

    return attempts.withWatermark("ts", forget).groupBy("host").applyInPandasWithState(step, "host string, id long, fails long, skipped boolean", "fail long, at double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table in memory: for small results and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
