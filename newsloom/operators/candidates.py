"""Candidates of a collection run: kept once, allowed, put in order, capped, and labelled with what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .merge import first_per_key


def unique(candidates: DataFrame, key: str = "url_key", arrival: str = "ordinal") -> DataFrame:
    """The first of each key in order of arrival."""
    return first_per_key(candidates, [key], arrival)


def priority() -> list[Column]:
    """Trusted and new, new, Go, popular, recent, popularity rank; then arrival."""
    new, trusted = ~F.col("known"), F.col("trusted")
    return [F.desc(trusted & new), F.desc(new), F.desc(F.col("bucket") == "baduk"), F.desc("is_popular"), F.desc_nulls_last("published"), F.coalesce("popularity_rank", F.lit(999)).asc(), F.asc("ordinal")]


def in_order(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*priority())))


def batch(candidates: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The first of each bucket, as many as the bucket may have."""
    caps = caps or fixed.BATCH
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("bucket"))
    return in_order(candidates).filter(F.col("place") <= F.coalesce(cap, F.lit(0)))


def labelled(candidates: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """candidates with the label of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return candidates.withColumn("outcome", out)


def outcomes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("bucket", "outcome").agg(F.count("*").alias("n"))


def distinct_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.countDistinct("url_key").alias("unique_keys"), F.countDistinct(F.when(~F.col("known"), F.col("url_key"))).alias("new_keys"), F.countDistinct(F.when(F.col("known"), F.col("url_key"))).alias("existing_keys"))


def top_per_page(rows: DataFrame, n: int, page: str = "page", rank: str = "pos") -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(rank))).filter(F.col("place") <= n)


def interleaved(rows: DataFrame, page_order: str, place: str = "place") -> DataFrame:
    """The first of each page, then the second of each: as a number, so that order survives."""
    return rows.withColumn("turn", F.row_number().over(Window.orderBy(place, page_order)))


def retries(articles: DataFrame, attempts: DataFrame, now: str, most: int, tries: int = 6, hours: int = 20) -> DataFrame:
    """Articles without a summary that may be tried again: Go first, least tried, longest not tried, longest body."""
    tried, last = F.coalesce("attempts", F.lit(0)), F.col("last_attempt")
    rows = articles.filter(F.col("summary_quality") == "none").join(attempts, "url_key", "left")
    rows = rows.filter((tried < tries) & (last.isNull() | (last <= F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours"))))
    order = [F.desc(F.col("category") == "바둑"), tried.asc(), last.asc_nulls_first(), F.desc(F.length("body_text")), F.asc("id")]
    return rows.withColumn("attempts", tried.cast("long")).orderBy(*order).limit(most)


def cursor_page(rows: DataFrame, cursor: int, n: int) -> DataFrame:
    """The n rows after the cursor; at the end, those from the start."""
    page = rows.filter(F.col("id") > cursor).orderBy("id").limit(n)
    return rows.orderBy("id").limit(n) if page.isEmpty() else page
