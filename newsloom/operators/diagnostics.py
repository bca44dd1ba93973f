"""What runs say of themselves, out of messages whose shape drifts, and the figures that health checks ask for.

A message is JSON text; as a VARIANT it needs no schema, and what is missing, of another type or unreadable is nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.gates import quality_conjuncts
from ..functions.text import any_of, display_relevant_c
from ..functions.times import effective_time, korea_day
from ..lineage import cut
from . import reports
from .stories import keyword_pairs

_D = "$.diagnostics"
_BADUK = f"{_D}.candidate_outcomes_by_category.baduk"


def parsed(runs: DataFrame) -> DataFrame:
    """runs with v, the message as a VARIANT (null if it can't be read)."""
    return runs.withColumn("v", F.try_parse_json("message"))


def number(path: str, v: str = "v") -> Column:
    """The number at a path, also one written as text; 0 if there is none."""
    return F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0))


def text(path: str, v: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def entries(rows: DataFrame, path: str, *keep: str, v: str = "v") -> DataFrame:
    """(keep, key, n): the entries of the object at a path, as numbers."""
    at = rows.select(*keep, F.try_variant_get(v, path, "variant").alias("at_")).filter("schema_of_variant(at_) like 'OBJECT%'")
    found = at.lateralJoin(at.sparkSession.tvf.variant_explode(F.col("at_").outer()))
    return found.select(*keep, "key", F.coalesce(F.expr("try_variant_get(value, '$', 'double')"), F.lit(0.0)).alias("n"))


def leaves(runs: DataFrame) -> DataFrame:
    """(path, runs, total): every number in the messages by its path, at any depth: in how many runs, and their sum.

    A level of objects is taken apart at a time, for as many levels as there are. Lists are not gone into."""
    level = cut(parsed(runs).filter("v is not null").select("id", F.lit("$").alias("path"), F.col("v").alias("node")))
    found = None
    while True:
        nested = level.filter("schema_of_variant(node) like 'OBJECT%'").select("id", "path", "node")
        below = nested.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer())).select("id", F.concat_ws(".", "path", "key").alias("path"), F.col("value").alias("node"))
        level = cut(below)
        if level.isEmpty():
            break
        numbers = level.filter("schema_of_variant(node) rlike '^(BIGINT|DOUBLE|DECIMAL|FLOAT)'").select("id", "path", F.expr("try_variant_get(node, '$', 'double')").alias("n"))
        found = numbers if found is None else found.union(numbers)
    if found is None:
        found = level.select("id", "path", F.lit(0.0).alias("n")).filter("false")
    return found.groupBy("path").agg(F.countDistinct("id").alias("runs"), F.round(F.sum("n"), 4).alias("total"))


def rejections(runs: DataFrame) -> DataFrame:
    """(rule, n): summaries turned away by each rule."""
    return entries(parsed(runs), f"{_D}.summary_rejected_by_rule").groupBy(F.col("key").alias("rule")).agg(F.sum("n").cast("long").alias("n"))


def recent(runs: DataFrame, now: str, most: int = 30) -> DataFrame:
    """The newest runs of 24 hours that have diagnostics, most of them at most: what a health answer looks at."""
    rows = runs.filter((F.col("started_at") >= F.to_timestamp(F.lit(now)) - F.expr("interval 24 hours")) & F.col("message").contains("diagnostics"))
    return rows.orderBy(F.desc("id")).limit(most)


def run_figures(runs: DataFrame) -> DataFrame:
    """One row: what the runs' diagnostics add up to."""
    v = parsed(runs).filter(F.expr(f"try_variant_get(v, '{_D}', 'variant')").isNotNull())
    seen = number(f"{_D}.processed_by_category.baduk")
    starved = text(f"{_D}.anthropic_exhausted_reason").isin("bucket_baduk", "daily_total") & (seen > 0) & (number(f"{_D}.anthropic_calls_by_bucket.baduk") < fixed.RESERVED_CALLS)
    counts = F.try_variant_get("v", f"{_D}.subrequests_used", "variant").isNotNull()
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    sums = v.agg(
        F.count_if(starved).alias("quota_blocked"), total(seen, "baduk_seen"), total(number(f"{_BADUK}.body_too_short"), "baduk_short"),
        total(number(f"{_BADUK}.inserted_publishable") + number(f"{_BADUK}.existing_repaired"), "baduk_published"), total(number(f"{_D}.subrequest_budget_stopped"), "budget_stopped"),
    )
    over = entries(v.filter(counts), f"{_D}.body_too_short_hosts").agg(F.count_if(F.col("key").rlike("(?i)Too many subrequests")).alias("budget_exceeded"))
    rejected = entries(v, f"{_D}.summary_rejected_by_rule").agg(total(F.col("n"), "paid_rejected"))
    return side_by_side(sums, over, rejected)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    first, *rest = [df.withColumn("one_", F.lit(1)) for df in one_row]
    for df in rest:
        first = first.join(df, "one_")
    return first.drop("one_")


def health_figures(articles: DataFrame, attempts: DataFrame, checks: DataFrame, runs: DataFrame, state: DataFrame, now: str, hard_limit: int = fixed.MONTHLY_SPEND, room: int = 500 << 20) -> DataFrame:
    """One row with a figure for each condition of reports.HEALTH_CHECKS.

    runs: (id, started_at, finished_at, status, message); state: (key, value: text), with baduk_source_latest, ai_blocked,
    claude_monthly_micro_usd, d1_rows_read, database_bytes, each of which may be missing."""
    t = F.to_timestamp(F.lit(now))
    hours = lambda c: (F.unix_timestamp(t) - F.unix_timestamp(c)) / 3600
    last = runs.agg(F.max_by(F.struct("status", hours(F.col("started_at")).alias("started"), hours(F.col("finished_at")).alias("finished")), "id").alias("r"))
    # a run that goes on is as fresh as its start
    last = last.select(F.col("r.status").alias("last_status"), F.when((F.col("r.status") == "running") & (F.col("r.started") <= 0.25), F.col("r.started")).otherwise(F.col("r.finished")).alias("last_age_hours"))
    automatic = parsed(runs).filter(text(f"{_D}.mode") == "scheduled").agg(F.max_by(hours(F.col("finished_at")), "id").alias("automatic_age_hours"))
    rows = articles.withColumn("when_ts", effective_time(F.col("published_at"), F.col("fetched_at")))
    full = rows.filter((F.col("summary_quality") == "full") & (F.col("when_ts") >= t - F.expr("interval 24 hours")))
    paid = full.filter(F.col("category") != "바둑").orderBy(F.desc("id")).limit(60).select("id", "title", korea_day(F.col("when_ts")).alias("day"))
    paid = keyword_pairs(paid, 3).agg(F.count("*").alias("duplicate_paid"))
    go = full.filter(F.col("category") == "바둑")
    stored = go.agg(F.count("*").alias("stored_"))
    good = go
    for c in quality_conjuncts(*[F.col(x) for x in ("title", "summary", "summary_quality", "url")]):
        good = good.filter(c)
    good = good.orderBy(F.desc("id")).limit(60)
    shown = display_relevant_c(F.col("title"), F.col("summary")) & ~any_of(F.col("title"), fixed.PROMO_TITLE)
    stages = good.agg(F.count("*").alias("good_"), F.count_if(shown).alias("baduk_after_promo"))
    source = rows.filter((F.col("category") == "바둑") & (F.col("summary_quality") == "full") & F.col("url").contains(fixed.TIMELESS_HOST)).agg(F.date_format(F.max("when_ts"), "yyyy-MM-dd").alias("stored_day"))
    told = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    told_number = lambda k: F.coalesce(told(k).try_cast("double"), F.lit(0.0))
    stated = state.agg(
        F.nullif(told("baduk_source_latest"), F.lit("")).alias("source_day"), (told_number("ai_blocked") != 0).alias("provider_blocked"), (told_number("claude_monthly_micro_usd") >= hard_limit).alias("over_hard_limit"),
        told_number("d1_rows_read").alias("rows_read"), (told_number("database_bytes") / room * 100).alias("storage_percent"),
    )
    exhausted = reports.status_recovery(articles, attempts).select("exhausted")
    out = side_by_side(reports.health_counts(articles, checks, now), run_figures(recent(runs, now)), last, automatic, paid, stored, stages, source, stated, exhausted)
    # past 60 rows what the quality rules took can't be told
    by_rules = F.when(F.col("stored_") > 60, 0).otherwise(F.col("stored_") - F.col("good_"))
    return out.withColumn("over_filtered", F.col("good_") - F.col("baduk_after_promo") + by_rules).withColumn("paid_published", F.col("baduk_published"))
