"""Issues of a page out of the cache as it was at a time: payload, groups, members, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import issues

GROUPS = "array<struct<key:string,title:string,url_keys:array<string>>>"


def as_of(history: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (category, at) with payload and built_at: of the category's history (category, id, payload, built_at) the newest row that
    was built by then, the larger id of two at once; no row, if there is none. Only times and ids are grouped; the payload comes
    after, by its id, so that what moves doesn't grow with its size."""
    found = asked.join(history.select("category", "id", "built_at"), "category").filter("built_at <= at")
    newest = found.groupBy("category", "at").agg(F.max(F.struct("built_at", "id")).alias("n"))
    return newest.select("category", "at", F.col("n.id").alias("id")).join(history, ["category", "id"]).select("category", "at", "payload", "built_at")


def groups_of(payloads: DataFrame) -> DataFrame:
    """(category, at, place, key, title, url_keys): the groups of each payload in order. What is not a list of groups holds none."""
    told = F.from_json("payload", GROUPS)
    rows = payloads.filter(F.ltrim("payload").startswith("[")).select("category", "at", F.posexplode(told).alias("place", "g"))
    none = F.array().cast("array<string>")
    return rows.select("category", "at", "place", F.coalesce("g.key", F.lit("")).alias("key"), F.coalesce("g.title", F.lit("")).alias("title"), F.coalesce("g.url_keys", none).alias("url_keys"))


def page_issues(cards: DataFrame, history: DataFrame, category: str, at: str, cap: int) -> DataFrame:
    """(key, title, count, latest, score, shown): the tiles of a page whose cards (ord, url_key, category, title, summary, related_count,
    moment, score) are given, by the category's cache as it was at a time; no rows if it had none.

    Groups whose titles name one event are one; keys without a card on the page go, as does what issues.normalized() turns away;
    stories count with their related ones; cap bounds the tiles. A page bounds the cards, and a payload the groups."""
    asked = cards.sparkSession.range(1).select(F.lit(category).alias("category"), F.to_timestamp(F.lit(at)).alias("at"))
    found = groups_of(as_of(history, asked)).select("category", F.col("place").alias("at"), "key", "title", "url_keys")
    cache = cut(issues.merge_groups(found))  # looked at several times, and small
    kept = issues.normalized(cards, cache.select("ord", "key", "title", "url_keys"))
    members = kept.select("key", "title", F.explode("url_keys").alias("url_key")).join(cards.select("url_key", "related_count", F.col("moment").alias("at"), "score"), "url_key")
    return issues.tiles(issues.issue_counts(members), cap)
