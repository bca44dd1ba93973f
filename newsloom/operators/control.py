"""Budgets, caps, quarantine and other state that runs keep: as folds over ordered rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.times import korea, korea_day, korea_month


def publish_counts(articles: DataFrame, now: str, time: str = "when_ts") -> DataFrame:
    """By bucket: published in the Korean month and on the Korean day of now."""
    t = F.to_timestamp(F.lit(now))
    month = articles.filter(korea_month(F.col(time)) == korea_month(t))
    return month.groupBy("bucket").agg(F.count("*").alias("this_month"), F.count_if(korea_day(F.col(time)) == korea_day(t)).alias("today"))


def capped_per_day(articles: DataFrame, cap: int = fixed.PUBLISH_CAP, time: str = "when_ts") -> DataFrame:
    """The first cap of each bucket and Korean day."""
    order = Window.partitionBy("bucket", "kst_day").orderBy(time, "id")
    return articles.withColumn("kst_day", korea_day(F.col(time))).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def within_budget(calls: DataFrame, budget: int = fixed.SUBREQUESTS, run: str = "run", order: str = "ordinal", cost: str = "cost") -> DataFrame:
    """calls with used (cost of the run so far, this one included) and fits: a run's calls in order, until the budget is used up."""
    used = F.sum(cost).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("used", used).withColumn("fits", used <= budget)


def call_limit(kst_hour: int, bucket: str, boost: bool = False, recovery: bool = False) -> int:
    """Model calls a day that a bucket may reach in all: part is kept for Go until nine in the evening."""
    total = fixed.RECOVERY_CALLS if recovery else fixed.DAILY_CALLS + (fixed.BOOST_CALLS if boost else 0)
    if bucket == "baduk" or recovery or kst_hour >= 21:
        return total
    return fixed.DAILY_CALLS - fixed.RESERVED_CALLS + (fixed.BOOST_CALLS if boost else 0)


def spend_gate(monthly: Column, daily: Column, next_cost: Column) -> Column:
    """Why a paid call is not made: 'monthly' before 'daily', '' if it may be."""
    return F.when(monthly + next_cost > fixed.MONTHLY_SPEND, "monthly").when(daily + next_cost > fixed.DAILY_SPEND, "daily").otherwise("")


def settle(events: Iterable[tuple[str, int]]) -> int:
    """Spend after ('reserve', cost) and ('settle', actual - reserved) in order, never below 0."""
    total = 0
    for _, amount in events:
        total = max(0, total + amount)
    return total


def tumbling_days(events: DataFrame, time: str = "ts") -> DataFrame:
    """Counts and sums by Korean day."""
    return events.groupBy(korea_day(F.col(time)).alias("kst_day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def late_or_future(rows: DataFrame, now: str, time: str, late_days: int = 30, future_hours: int = 2) -> DataFrame:
    t = F.to_timestamp(F.lit(now))
    label = F.when(F.col(time) < t - F.expr(f"interval {late_days} days"), "too_old").when(F.col(time) > t + F.expr(f"interval {future_hours} hours"), "future").otherwise("kept")
    return rows.withColumn("lateness", label)


def neutralised(published: Column, now: str, hours: int = 2) -> Column:
    """'' in place of a time that lies ahead."""
    return F.when(published.try_cast("timestamp") > F.to_timestamp(F.lit(now)) + F.expr(f"interval {hours} hours"), "").otherwise(published)


def stale_runs(runs: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_at") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {minutes} minutes"))
    return runs.withColumn("status", F.when(stale, "error").otherwise(F.col("status")))


def kst_hour(c: Column) -> Column:
    return F.hour(korea(c))


# --- quarantine of hosts ------------------------------------------------------------------------------


class HostLedger:
    """Consecutive failures that are the host's own; five of them keep it out for a day, then it is tried once. Success clears it."""

    def __init__(self, stored: str | None = None):
        try:
            ledger = json.loads(stored or "{}")
        except ValueError:
            ledger = {}
        ok = isinstance(ledger, dict) and ledger.get("__rule") == fixed.QUARANTINE_RULE
        self.hosts: dict[str, list] = {h: [r["fail"], r["at"]] for h, r in ledger.items() if h != "__rule"} if ok else {}

    def record(self, host: str, ok: bool, status: str, at: float) -> None:
        if not host or re.search(fixed.NEVER_QUARANTINED, host):
            return
        if ok:
            self.hosts.pop(host, None)
        elif re.search(fixed.HOST_FAILURE, status or ""):
            self.hosts[host] = [self.hosts.get(host, [0])[0] + 1, at]

    def closed(self, host: str, at: float) -> bool:
        fail, last = self.hosts.get(host, (0, 0.0))
        return bool(host) and not re.search(fixed.NEVER_QUARANTINED, host) and fail >= fixed.QUARANTINE_FAILS and at - last < fixed.QUARANTINE_HOURS * 3600

    def stored(self, now: float) -> str:
        fresh = {h: {"fail": f, "at": t} for h, (f, t) in self.hosts.items() if t >= now - 2 * fixed.QUARANTINE_HOURS * 3600}
        return json.dumps({"__rule": fixed.QUARANTINE_RULE, **fresh}, ensure_ascii=False, sort_keys=True)


def quarantine(attempts: DataFrame) -> DataFrame:
    """(host, at, id, fails, skipped) for attempts (host, at, id, ok, status) of each host in order: a skipped one changes nothing.

    A host's attempts come to one task in order of time; hosts are independent."""

    def fold(host: pd.DataFrame) -> pd.DataFrame:
        ledger, out = HostLedger(), []
        for r in host.sort_values(["at", "id"]).itertuples():
            t = r.at.timestamp()
            skipped = ledger.closed(r.host, t)
            if not skipped:
                ledger.record(r.host, bool(r.ok), r.status, t)
            out.append((r.host, r.id, ledger.hosts.get(r.host, [0])[0], skipped))
        return pd.DataFrame(out, columns=["host", "id", "fails", "skipped"])

    return attempts.select("host", "at", "id", "ok", "status").groupBy("host").applyInPandas(fold, "host string, id long, fails long, skipped boolean")


# --- diagnostics --------------------------------------------------------------------------------------


def bounded_json(value: dict, most: int) -> str:
    """JSON of at most so many characters: the largest entries go first, and what is left is always valid."""
    value = dict(value)
    while len(s := json.dumps(value, ensure_ascii=False, separators=(",", ":"))) > most and value:
        largest = max(value, key=lambda k: len(json.dumps(value[k], ensure_ascii=False)))
        del value[largest]
    return s


def metered(rows: DataFrame, name: str = "rows_read") -> tuple[DataFrame, object]:
    """rows, and an observation that counts those read once an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias(name)), seen


def fuse_blown(rows_read: int, most: int = fixed.READ_FUSE) -> bool:
    return rows_read >= most
