"""The feed query: articles with a user's flags, like counts and popularity, filtered, ordered and, if asked, limited."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.gates import quality_conjuncts
from ..functions.times import effective_time, korea_day
from .search import matching

VIEWS = ("latest", "saved", "hidden", "popular", "home")


@dataclass(frozen=True)
class FeedParams:
    now: str
    user_id: str = "default"
    view: str = "latest"
    category: str = ""
    hours: int = 0
    query: str = ""
    exclude_baduk: bool = False
    limit: int | None = None
    quality: bool = True

    def clamped(self) -> FeedParams:
        limit = None if self.limit is None else min(max(self.limit or 60, 1), 300)
        return replace(self, user_id=self.user_id[:100], view=self.view if self.view in VIEWS else "latest", hours=min(max(self.hours, 0), 720), query=self.query.strip()[:100], limit=limit)


def pool_size(limit: int, view: str, issues: bool = False, baduk: bool = False) -> int:
    """Rows to read before stories are folded: more for issues and the compact views."""
    size = (min(240, max(2 * limit, 120)) if baduk else min(limit, 150)) if issues else limit
    return min(150, max(size, 5 * limit, 50)) if view in ("home", "popular") else size


def baduk_tab(title: Column, summary: Column, category: Column) -> Column:
    return (category == "바둑") | title.contains("바둑") | (title.contains("기원") & summary.contains("바둑"))


def with_popularity(articles: DataFrame, popularity: DataFrame, items: DataFrame) -> DataFrame:
    """The larger of the score by key and the score by title; 0 if neither is known."""
    by_key = popularity.groupBy("url_key").agg(F.max("score").alias("score_by_key"))
    by_title = items.groupBy("title").agg(F.max("score").alias("score_by_title"))
    joined = articles.join(by_key, "url_key", "left").join(by_title, "title", "left")
    score = F.greatest(F.coalesce("score_by_key", F.lit(0.0)), F.coalesce("score_by_title", F.lit(0.0)))
    return joined.withColumn("popularity_score", score).drop("score_by_key", "score_by_title")


def ranked_only(articles: DataFrame, popularity: DataFrame, items: DataFrame) -> DataFrame:
    """Articles that some ranking knows by key or by title: two keys, so two existence joins rather than one on 'or'."""
    keys = popularity.select("url_key").distinct().withColumn("by_key", F.lit(True))
    titles = items.select("title").distinct().withColumn("by_title", F.lit(True))
    return articles.join(keys, "url_key", "left").join(titles, "title", "left").filter("by_key or by_title").drop("by_key", "by_title")


def feed(articles: DataFrame, saved: DataFrame, hidden: DataFrame, likes: DataFrame, popularity: DataFrame, items: DataFrame, params: FeedParams, trigrams: DataFrame | None = None) -> DataFrame:
    """trigrams: the table of search.append_trigrams, which a search then reads in place of all titles and summaries."""
    p = params.clamped()
    now = F.to_timestamp(F.lit(p.now))
    mine = lambda t: t.filter(F.col("user_id") == p.user_id).select("url_key").distinct()
    rows = articles.withColumn("when_ts", effective_time(F.col("published_at"), F.col("fetched_at")))
    if p.view not in ("saved", "hidden"):
        rows = rows.filter(F.col("when_ts") >= now - F.expr(f"interval {p.hours or 720} hours"))
    if p.quality:
        rows = rows.filter(reduce(and_, quality_conjuncts(F.col("title"), F.col("summary"), F.col("summary_quality"), F.col("url"))))
    if p.category == "바둑":
        rows = rows.filter(baduk_tab(F.col("title"), F.col("summary"), F.col("category")))
    elif p.category:
        rows = rows.filter(F.col("category") == p.category)
    if p.exclude_baduk and p.category != "바둑":
        rows = rows.filter(~F.col("category").isin(*fixed.EXCLUDED_FROM_GENERAL))
    if p.query:
        rows = matching(rows, p.query, trigrams)
    rows = rows.join(mine(hidden), "url_key", "left_semi" if p.view == "hidden" else "left_anti")
    if p.view == "saved":
        rows = rows.join(mine(saved), "url_key", "left_semi")
    if p.view == "popular":
        rows = ranked_only(rows, popularity, items)
    flag = lambda t, name: mine(t).withColumn(name, F.lit(1))
    count = likes.groupBy("url_key").agg(F.count("*").alias("like_count"))
    rows = rows.join(flag(saved, "saved"), "url_key", "left").join(flag(likes, "liked"), "url_key", "left").join(count, "url_key", "left")
    rows = with_popularity(rows, popularity, items).fillna({"saved": 0, "liked": 0, "like_count": 0})
    score, when = F.desc("popularity_score"), F.desc("when_ts")
    by_day = not 0 < p.hours <= 24
    order = {"popular": [F.desc(korea_day(F.col("when_ts")))] * by_day + [score, when], "home": [F.desc(F.col("popularity_score") > 0), score, when]}.get(p.view, [when])
    rows = rows.orderBy(*order, "id")
    return rows.limit(p.limit) if p.limit else rows


def display_name(user: Column) -> Column:
    """The login name without the prefix that stored ids of accounts have; an id that is nothing else stays."""
    return F.coalesce(F.nullif(F.regexp_replace(user, "^account:", ""), F.lit("")), user)


def likers(likes: DataFrame, most: int = 100) -> DataFrame:
    """user, liked_at: who likes an article, of its likes (user_id, liked_at), the first ones first."""
    return likes.orderBy("liked_at", "user_id").limit(most).select(display_name(F.col("user_id")).alias("user"), "liked_at")
