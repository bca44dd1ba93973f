"""Status and health: each report is one scan with many conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import effective_time, is_date_only, stored_time
from .feed import baduk_tab


def _count(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def _published() -> Column:
    return F.col("summary_quality") == "full"


def status_totals(articles: DataFrame) -> DataFrame:
    long_enough = F.length("body_text") >= 300
    return articles.agg(F.count("*").alias("total"), F.max("fetched_at").alias("latest_fetch"), _count(_published(), "published"), _count(F.col("image_url") != "", "with_image"), _count(long_enough, "with_body"))


def status_by_category(articles: DataFrame, now: str) -> DataFrame:
    when = effective_time(F.col("published_at"), F.col("fetched_at"))
    recent = articles.filter(when >= F.to_timestamp(F.lit(now)) - F.expr("interval 30 days"))
    return recent.groupBy("category").agg(F.count("*").alias("total"), _count(_published(), "published"))


def status_by_day(articles: DataFrame, days: int = 31) -> DataFrame:
    """By the first ten characters of the stored time, newest first."""
    day = F.substring(F.coalesce(F.nullif("published_at", F.lit("")), "fetched_at"), 1, 10)
    return articles.groupBy(day.alias("day")).agg(F.count("*").alias("total")).orderBy(F.desc("day")).limit(days)


def status_recovery(articles: DataFrame, attempts: DataFrame, exhausted: int = 24) -> DataFrame:
    tried = F.coalesce("attempts", F.lit(0))
    open_ = F.col("summary_quality") == "none"
    n = F.length("body_text")
    return articles.join(attempts.select("url_key", "attempts"), "url_key", "left").agg(
        _count(open_, "waiting"), _count(open_ & (n >= 300), "body_ready"), _count(open_ & n.between(180, 299), "body_thin"), _count(open_ & (n < 180), "body_short"),
        _count(open_ & (tried == 0), "never_tried"), _count(open_ & tried.between(1, exhausted - 1), "tried"), _count(open_ & (tried >= exhausted), "exhausted"),
    )


def health_counts(articles: DataFrame, checks: DataFrame, now: str) -> DataFrame:
    t = F.to_timestamp(F.lit(now))
    rows = articles.join(checks.select("url_key").distinct().withColumn("checked", F.lit(True)), "url_key", "left")
    rows = rows.withColumn("when_ts", effective_time(F.col("published_at"), F.col("fetched_at"))).withColumn("pub_ts", stored_time(F.nullif("published_at", F.lit(""))))
    day = F.col("when_ts") >= t - F.expr("interval 24 hours")
    baduk = baduk_tab(F.col("title"), F.col("summary"), F.col("category"))
    return rows.agg(
        _count(day & baduk, "baduk_24h"), _count(day & (F.col("category") != "바둑"), "general_24h"), _count(F.col("published_at") == "", "time_missing"),
        _count(is_date_only(F.col("published_at")) & F.col("checked").isNull(), "date_only"), _count(F.col("pub_ts") > t + F.expr("interval 2 hours"), "in_future"),
        _count(F.col("url").contains("sports.naver.com"), "broken_urls"), F.max(F.date_format("when_ts", "yyyy-MM-dd")).alias("latest_day"),
    )


def predicate_hits(rows: DataFrame, conjuncts: list[Column]) -> DataFrame:
    """How many rows each conjunct alone turns away (f0, f1, ...), and how many pass all."""
    passed = conjuncts[0]
    for c in conjuncts[1:]:
        passed = passed & c
    return rows.agg(*[F.count_if(~c).alias(f"f{i}") for i, c in enumerate(conjuncts)], F.count_if(passed).alias("passed"))


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each stage."""
    left, out = F.lit(True), [F.count("*").alias("stored")]
    for name, c in stages:
        left = left & c
        out.append(F.count_if(left).alias(name))
    return rows.agg(*out)


def run_diagnostics(runs: DataFrame, key: str = "k") -> DataFrame:
    """Counters of the runs' JSON messages, summed by name; what cannot be read counts as nothing."""
    counts = F.from_json("message", "map<string,double>")
    return runs.select(F.explode(counts).alias("name", "n")).filter("n is not null").groupBy("name").agg(F.count("*").alias("runs"), F.sum("n").cast("long").alias("total"))


def top_popularity(by_key: DataFrame, by_title: DataFrame, n: int = 12) -> DataFrame:
    """Best rank, then most recent, over two rankings."""
    a = by_key.groupBy(F.col("url_key").alias("key")).agg(F.min("rank").alias("best"), F.max("collected_at").alias("latest")).withColumn("kind", F.lit("key"))
    b = by_title.groupBy(F.col("title").alias("key")).agg(F.min("rank").alias("best"), F.max("collected_at").alias("latest")).withColumn("kind", F.lit("title"))
    return a.unionByName(b).orderBy("best", F.desc("latest"), "kind", "key").limit(n)


#: name -> condition under which a check passes, over a one-row table of health figures
HEALTH_CHECKS = (
    ("last_run_ok", "last_status in ('ok', 'degraded') or (last_status = 'running' and last_age_hours <= 0.25)"),
    ("last_run_within_6h", "last_age_hours <= 6"),
    ("automatic_run_within_4h", "automatic_age_hours <= 4"),
    ("general_has_recent_news", "general_24h > 0"),
    ("baduk_source_collected", "source_day is null or stored_day >= source_day"),
    ("baduk_body_fetch_healthy", "baduk_short < 6 or baduk_published > 0"),
    ("baduk_reaches_screen", "baduk_seen = 0 or baduk_after_promo > 0"),
    ("subrequest_budget_respected", "budget_exceeded = 0"),
    ("stored_urls_openable", "broken_urls = 0"),
    ("duplicate_paid_summaries_low", "duplicate_paid < 2"),
    ("published_time_healthy", "time_missing <= 3"),
    ("published_time_has_clock", "date_only <= 5"),
    ("published_time_not_future", "in_future = 0"),
    ("baduk_ai_quota_available", "quota_blocked < 3"),
    ("paid_summary_reaches_screen", "paid_rejected < 10 or paid_published > 0"),
    ("baduk_display_not_over_filtered", "over_filtered < 2"),
    ("cloudflare_not_provider_blocked", "not provider_blocked"),
    ("claude_under_hard_limit", "not over_hard_limit"),
    ("summary_exhausted_below_threshold", "exhausted < 15"),
    ("d1_reads_under_daily_limit", "rows_read < 1000000"),
    ("database_storage_below_70_percent", "storage_percent < 70"),
)


def health_checks(figures: DataFrame) -> DataFrame:
    """A boolean a check, and the names of those that fail. A figure that is not known fails its check."""
    checks = [F.coalesce(F.expr(condition), F.lit(False)).alias(name) for name, condition in HEALTH_CHECKS]
    out = figures.select(*checks)
    return out.withColumn("failures", F.filter(F.array(*[F.when(~F.col(n), F.lit(n)) for n, _ in HEALTH_CHECKS]), lambda x: x.isNotNull()))


def storage_level(percent: Column) -> Column:
    return F.when(percent >= 85, "danger").when(percent >= 70, "warn").otherwise("ok")


def stalled(run: dict, now_ms: int) -> bool:
    """A watchdog's verdict on a health answer: unreachable, not 200, running, no run, or over four hours since one."""
    if not run.get("reachable") or run.get("status") != 200:
        return True
    if (run.get("last_run") or {}).get("status") == "running":
        return False
    started = (run.get("last_automatic_run") or {}).get("started_ms")
    return started is None or now_ms - started > 4 * 3_600_000
