"""Queries over the stand-in tables, with the SQL that gives the same rows: feed, merges, reports, budgets, issues."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.extract import allowed_c, host_c
from ..functions.gates import quality_conjuncts
from ..functions.times import cost_micro_usd, daily_allowance, effective_time, is_date_only, korea, korea_day
from ..lineage import new_folder
from ..operators import candidates as C
from ..operators import control, issues, merge, repairs, reports, search
from ..operators.diagnostics import side_by_side
from ..operators.feed import FeedParams, feed, likers, ranked_only
from .standin import NOW, USER, Tables, sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return f

    return keep


# --- feed -----------------------------------------------------------------------------------------------

_SHOWN = ("id", "title", "category", "when_at", "saved", "liked", "like_count", "popularity_score")


def _feed(t: Tables, trigrams: DataFrame | None = None, **params) -> DataFrame:
    p = FeedParams(now=NOW, user_id=USER, **params)
    rows = feed(t.articles(), t.saved(), t.hidden(), t.likes(), t.popularity(), t.popular_items(), p, trigrams)
    return rows.withColumn("when_at", F.date_format("when_ts", "yyyy-MM-dd HH:mm:ss")).select(*_SHOWN)


_CONJUNCTS = [
    "(summary_quality = 'duplicate' OR (summary_quality = 'full' AND trim(summary) <> ''))",
    "instr(title, '�') = 0",
    *[f"NOT contains(lower(url), '{h}')" for h in fixed.BLOCKED_HOSTS],
    *[f"NOT contains(summary, '{p}')" for p in fixed.SUMMARY_PHRASES],
    *[f"NOT contains(title, '{p}')" for p in fixed.TITLE_PHRASES],
]
_QUALITY = " AND ".join(_CONJUNCTS)


def _feed_sql(where: str = "TRUE", hidden: str = "NOT", window: str = "INTERVAL 30 DAY", end: str = "") -> str:
    inside = f"a.when_ts >= TIMESTAMP '{NOW}' - {window} AND " if window else ""
    return f"""
    SELECT id, title, category, strftime(when_ts, '%Y-%m-%d %H:%M:%S') AS when_at,
      CAST(EXISTS (SELECT 1 FROM saved s WHERE s.url_key = a.url_key AND s.user_id = '{USER}') AS INTEGER) AS saved,
      CAST(EXISTS (SELECT 1 FROM likes l WHERE l.url_key = a.url_key AND l.user_id = '{USER}') AS INTEGER) AS liked,
      (SELECT count(*) FROM likes l WHERE l.url_key = a.url_key) AS like_count,
      greatest(coalesce((SELECT max(score) FROM popularity p WHERE p.url_key = a.url_key), 0), coalesce((SELECT max(score) FROM popular_items p WHERE p.title = a.title), 0)) AS popularity_score
    FROM timed a WHERE {inside}{_QUALITY} AND {where}
      AND {hidden} EXISTS (SELECT 1 FROM hidden h WHERE h.url_key = a.url_key AND h.user_id = '{USER}') {end}"""


@query("feed_latest", _feed_sql())
def _(t):
    return _feed(t)


@query("feed_home", _feed_sql())
def _(t):
    return _feed(t, view="home")


_RANKED = "(a.url_key IN (SELECT url_key FROM popularity) OR coalesce(a.title IN (SELECT title FROM popular_items), FALSE))"


@query("feed_popular_day", _feed_sql(_RANKED, window="INTERVAL 24 HOUR"))
def _(t):
    return _feed(t, view="popular", hours=24)


@query("feed_popular_month", _feed_sql(_RANKED, end="ORDER BY CAST(when_ts + INTERVAL 9 HOUR AS DATE) DESC, popularity_score DESC, when_ts DESC, id LIMIT 60"))
def _(t):
    return _feed(t, view="popular", limit=60)


@query("feed_saved", _feed_sql(f"EXISTS (SELECT 1 FROM saved s WHERE s.url_key = a.url_key AND s.user_id = '{USER}')", window=""))
def _(t):
    return _feed(t, view="saved")


@query("feed_hidden", _feed_sql(hidden="", window=""))
def _(t):
    return _feed(t, view="hidden")


@query("feed_search", _feed_sql("(title ILIKE '%TION%' OR summary ILIKE '%TION%' OR press ILIKE '%TION%')"))
def _(t):
    return _feed(t, query="TION")


@query("feed_search_trigrams", _feed_sql("(title ILIKE '%TION%' OR summary ILIKE '%TION%' OR press ILIKE '%TION%')"))
def _(t):
    path, articles = new_folder(t.spark, "trigrams"), t.articles()
    search.append_trigrams(articles, path)
    return _feed(t, search.read_trigrams(t.spark, path, articles), query="TION")


@query("feed_exclude", _feed_sql("category NOT IN ('바둑', 'IT/과학') AND category = 'fr'"))
def _(t):
    return _feed(t, category="fr", exclude_baduk=True)


@query("feed_baduk_tab", _feed_sql("(category = '바둑' OR contains(title, '바둑') OR (contains(title, '기원') AND contains(summary, '바둑')))"))
def _(t):
    return _feed(t, category="바둑")


@query("feed_page", _feed_sql(end="ORDER BY when_ts DESC, id LIMIT 60"))
def _(t):
    return _feed(t, limit=60)


_RANKED_IDS = """, keys AS MATERIALIZED (SELECT DISTINCT sha256(CAST(event_id % (SELECT nd FROM n) AS VARCHAR)) AS url_key FROM ev WHERE event_type = 'purchase'),
    known AS MATERIALIZED (SELECT id, url_key, title FROM articles),
    told AS MATERIALIZED (SELECT DISTINCT k.title FROM ev e JOIN known k ON k.id = e.event_id % (SELECT nd FROM n) WHERE e.event_type = 'signup' AND e.value > 50),
    ranked AS MATERIALIZED (SELECT id FROM known SEMI JOIN keys USING (url_key) UNION SELECT id FROM known SEMI JOIN told USING (title))"""


@query("feed_popular_exists", _RANKED_IDS + " SELECT id, url_key FROM known SEMI JOIN ranked USING (id)")
def _(t):
    return ranked_only(t.articles(), t.popularity(), t.popular_items()).select("id", "url_key")


@query("popular_disjunctive_flag", _RANKED_IDS + " SELECT k.id, r.id IS NOT NULL AS is_popular FROM known k LEFT JOIN ranked r USING (id)")
def _(t):
    ranked = ranked_only(t.articles(), t.popularity(), t.popular_items()).select("id", F.lit(True).alias("is_popular"))
    return t.articles().select("id").join(ranked, "id", "left").fillna(False, ["is_popular"])


# --- joins ------------------------------------------------------------------------------------------------


@query("unchecked_rows", "SELECT id, category FROM articles a WHERE url_key NOT IN (SELECT url_key FROM checks)")
def _(t):
    return t.articles().join(t.checks(), "url_key", "left_anti").select("id", "category")


@query("not_exists_checks", r"SELECT id, published_at FROM articles a WHERE regexp_full_match(published_at, '.{4}-.{2}-.{2}') AND NOT EXISTS (SELECT 1 FROM checks c WHERE c.url_key = a.url_key)")
def _(t):
    return t.articles().filter(is_date_only(F.col("published_at"))).join(t.checks(), "url_key", "left_anti").select("id", "published_at")


@query("attempts_left_join", "SELECT id, coalesce(attempts, 0) AS attempts FROM articles LEFT JOIN attempts USING (url_key)")
def _(t):
    return t.articles().join(t.attempts(), "url_key", "left").select("id", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(
    "retry_candidates",
    f"""SELECT id, coalesce(attempts, 0) AS attempts FROM articles LEFT JOIN attempts USING (url_key)
    WHERE summary_quality = 'none' AND coalesce(attempts, 0) < 6 AND (last_attempt IS NULL OR last_attempt <= TIMESTAMP '{NOW}' - INTERVAL 20 HOUR)
    ORDER BY category = '바둑' DESC, coalesce(attempts, 0), last_attempt NULLS FIRST, length(body_text) DESC, id LIMIT 4""",
)
def _(t):
    return C.retries(t.articles(), t.attempts(), NOW, 4).select("id", "attempts")


@query("like_counts", "SELECT id, (SELECT count(*) FROM likes l WHERE l.url_key = a.url_key) AS like_count FROM articles a")
def _(t):
    n = t.likes().groupBy("url_key").agg(F.count("*").alias("like_count"))
    return t.articles().join(n, "url_key", "left").select("id", F.coalesce("like_count", F.lit(0)).alias("like_count"))


_LIKED = "likes_at AS (SELECT 'account:' || CAST(user_id AS VARCHAR) AS user_id, sha256(CAST(event_id % (SELECT nd FROM n) AS VARCHAR)) AS url_key, min(ts) AS liked_at FROM ev WHERE event_type = 'view' GROUP BY 1, 2)"


@query(
    "likers",
    f", {_LIKED}, busy AS (SELECT url_key FROM likes_at GROUP BY url_key ORDER BY count(*) DESC, url_key LIMIT 1) SELECT regexp_replace(user_id, '^account:', '') AS \"user\", strftime(liked_at, '%Y-%m-%d %H:%M:%S') AS liked_at FROM likes_at WHERE url_key = (SELECT url_key FROM busy) ORDER BY likes_at.liked_at, user_id LIMIT 100",
)
def _(t):
    likes = t.likes_at()
    busy = likes.groupBy("url_key").count().orderBy(F.desc("count"), "url_key").limit(1).select("url_key")  # the article that most like
    found = likers(likes.join(busy, "url_key", "left_semi"))
    return found.select("user", F.date_format("liked_at", "yyyy-MM-dd HH:mm:ss").alias("liked_at"))


@query("likes_by_user", " SELECT user_id, count(*) AS n FROM likes GROUP BY user_id ORDER BY n DESC, user_id LIMIT 100")
def _(t):
    return t.likes().groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(100)


@query(
    "users_merged",
    """SELECT coalesce(d.username, c.username) AS username, coalesce(d.role, c.role) AS role FROM
    (SELECT CAST(c_custkey AS VARCHAR) AS username, c_mktsegment AS role FROM customer WHERE c_custkey % 2 = 0) d
    FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS username, 'configured' AS role FROM customer WHERE c_custkey % 3 = 0) c ON d.username = c.username""",
)
def _(t):
    c = t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("username"), F.col("c_mktsegment").alias("role"))
    db, configured = c.filter("k % 2 = 0").select("username", "role"), c.filter("k % 3 = 0").select("username", F.lit("configured").alias("fallback"))
    return db.join(configured, "username", "full_outer").select("username", F.coalesce("role", "fallback").alias("role"))


# --- quality ------------------------------------------------------------------------------------------------


def _conjuncts():
    return quality_conjuncts(F.col("title"), F.col("summary"), F.col("summary_quality"), F.col("url"))


@query("quality_filter", f"SELECT id FROM articles WHERE {_QUALITY}")
def _(t):
    return t.articles().filter(reduce(and_, _conjuncts())).select("id")


@query("quality_filter_hits", "SELECT count(*) FILTER (WHERE " + _QUALITY + ") AS passed, " + ", ".join(f"count(*) FILTER (WHERE NOT ({c})) AS f{i}" for i, c in enumerate(_CONJUNCTS)) + " FROM articles")
def _(t):
    return reports.predicate_hits(t.articles(), _conjuncts())


@query("quality_funnel", "SELECT count(*) AS stored, count(*) FILTER (WHERE summary_quality = 'full') AS full_quality, count(*) FILTER (WHERE summary_quality = 'full' AND press <> '') AS with_press, count(*) FILTER (WHERE summary_quality = 'full' AND press <> '' AND image_url <> '') AS with_image FROM articles")
def _(t):
    return reports.funnel(t.articles(), [("full_quality", F.col("summary_quality") == "full"), ("with_press", F.col("press") != ""), ("with_image", F.col("image_url") != "")])


# --- candidates ------------------------------------------------------------------------------------------------

_UNIQUE = ", once AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY ordinal) = 1)"
_ORDER = "trusted AND NOT known DESC, NOT known DESC, bucket = 'baduk' DESC, is_popular DESC, published DESC NULLS LAST, coalesce(popularity_rank, 999), ordinal"


@query("candidate_unique", _UNIQUE + " SELECT url_key, ordinal FROM once")
def _(t):
    return C.unique(t.candidates()).select("url_key", "ordinal")


@query("candidate_priority", _UNIQUE + f" SELECT url_key, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {_ORDER}) AS place FROM once")
def _(t):
    return C.in_order(C.unique(t.candidates())).select("url_key", "bucket", "place")


@query("candidate_batch", _UNIQUE + f" SELECT url_key, bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_ORDER}) AS place FROM once) WHERE place <= CASE bucket WHEN 'baduk' THEN 20 ELSE 12 END")
def _(t):
    return C.batch(C.unique(t.candidates())).select("url_key", "bucket", "place")


_OUTCOME = """CASE WHEN ordinal % 41 = 0 THEN 'invalid_metadata' WHEN host LIKE '%spam-farm%' THEN 'disallowed_url' WHEN published < DATE '2024-01-01' THEN 'too_old'
    WHEN known THEN 'existing' WHEN size < 3000 THEN 'body_too_short' ELSE 'inserted' END"""


@query("candidate_outcomes", f"SELECT bucket, {_OUTCOME} AS outcome, count(*) AS n FROM candidates GROUP BY 1, 2")
def _(t):
    rules = [(F.col("ordinal") % 41 == 0, "invalid_metadata"), (F.col("host").contains("spam-farm"), "disallowed_url"), (F.col("published") < "2024-01-01", "too_old"), (F.col("known"), "existing"), (F.col("size") < 3000, "body_too_short")]
    return C.outcomes(C.labelled(t.candidates(), rules, "inserted"))


@query("candidate_counts", "SELECT count(DISTINCT url_key) AS unique_keys, count(DISTINCT url_key) FILTER (WHERE NOT known) AS new_keys, count(DISTINCT url_key) FILTER (WHERE known) AS existing_keys FROM candidates")
def _(t):
    return C.distinct_counts(t.candidates())


@query("candidate_allowed", "SELECT ordinal, CASE WHEN discovery = 'KAKAO' THEN (host = 'v.daum.net' OR host LIKE '%.news.daum.net' OR host = 'news.daum.net') ELSE NOT (" + " OR ".join(f"host LIKE '%{h}'" for h in fixed.BLOCKED_HOSTS + fixed.WRAPPER_HOSTS) + ") END AS allowed FROM candidates")
def _(t):
    return t.candidates().select("ordinal", allowed_c(F.col("url"), F.col("discovery")).alias("allowed"))


_PAGES = ", rows_ AS (SELECT event_type AS page, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos FROM ev)"


def _pages(t: Tables) -> DataFrame:
    e = t.events().select(F.col("event_type").alias("page"), "event_id", "value")
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("value"), "event_id")))


@query("rank_top_per_page", _PAGES + " SELECT page, event_id, pos FROM rows_ WHERE pos <= 4")
def _(t):
    return C.top_per_page(_pages(t), 4).select("page", "event_id", "pos")


@query("rank_interleave", _PAGES + " SELECT page, event_id, row_number() OVER (ORDER BY pos, page) AS turn FROM rows_ WHERE pos <= 4")
def _(t):
    return C.interleaved(C.top_per_page(_pages(t), 4), "page").select("page", "event_id", "turn")


# --- merges ------------------------------------------------------------------------------------------------


@query("popularity_live", "SELECT url_key, score, rank, source, collected_at FROM popularity")
def _(t):
    return t.popularity().select("url_key", "score", "rank", "source", "collected_at")


@query("popularity_max_min", "SELECT url_key, max(score) AS score, min(rank) AS rank FROM popularity_log GROUP BY 1")
def _(t):
    return merge.popularity_backfill(t.popularity_log())


@query("popularity_archive", "SELECT url_key, max(score) AS score, arg_min(rank, arrival) AS rank FROM popularity_log GROUP BY 1")
def _(t):
    return merge.popularity_archive(t.popularity_log())


_NEW = """, incoming AS (SELECT * REPLACE (title || '!' AS title, CASE WHEN id % 2 = 0 THEN body_text || ' more' ELSE '' END AS body_text, left(summary, 20) AS summary, 'none' AS summary_quality) FROM articles WHERE id % 3 = 0
    UNION ALL SELECT * REPLACE (id + 1000000 AS id, sha256('new' || id) AS url_key) FROM articles WHERE id % 7 = 0)"""


ARTICLE_UPSERT = (
    _NEW
    + """ SELECT CASE WHEN o.url_key IS NULL THEN n.id ELSE o.id END AS id, coalesce(n.title, o.title) AS title, coalesce(n.summary_quality, o.summary_quality) AS summary_quality,
    length(CASE WHEN n.url_key IS NOT NULL AND (o.url_key IS NULL OR length(n.body_text) > length(o.body_text)) THEN n.body_text ELSE o.body_text END) AS body_length,
    length(CASE WHEN n.url_key IS NOT NULL AND (o.url_key IS NULL OR length(n.summary) > length(o.summary)) THEN n.summary ELSE o.summary END) AS summary_length
    FROM articles o FULL JOIN incoming n ON o.url_key = n.url_key"""
)


def changed_articles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(articles, those that come again changed or are new)."""
    a = t.articles()
    body = F.when(F.col("id") % 2 == 0, F.concat("body_text", F.lit(" more"))).otherwise("")
    changed = a.filter("id % 3 = 0").withColumns({"title": F.concat("title", F.lit("!")), "body_text": body, "summary": F.substring("summary", 1, 20), "summary_quality": F.lit("none")})
    new = a.filter("id % 7 = 0").withColumns({"url_key": F.sha2(F.concat(F.lit("new"), F.col("id")), 256), "id": F.col("id") + 1000000})
    return a, changed.unionByName(new)


@query("article_upsert", ARTICLE_UPSERT)
def _(t):
    out = merge.upsert_articles(*changed_articles(t))
    return out.select("id", "title", "summary_quality", F.length("body_text").alias("body_length"), F.length("summary").alias("summary_length"))


@query("conditional_update", "SELECT id, CASE WHEN id % 5 = 0 THEN 'Daily' ELSE press END AS press, CASE WHEN id % 5 = 0 AND image_url = '' THEN 'https://new.example.com/y.jpg' ELSE image_url END AS image_url FROM articles")
def _(t):
    a = t.articles()
    new = a.filter("id % 5 = 0").select("url_key", F.lit("Daily").alias("press"), F.when(F.col("image_url") == "", "https://new.example.com/y.jpg").otherwise("").alias("image_url"))
    return merge.fill_if_told(a, new, "url_key", ["press", "image_url"]).select("id", "press", "image_url")


@query("insert_or_ignore", "SELECT user_id, url_key FROM saved UNION SELECT user_id, url_key FROM likes")
def _(t):
    return merge.insert_or_ignore(t.saved(), t.likes(), ["user_id", "url_key"])


@query("hide_batch", "SELECT 'saved' AS t, user_id, url_key FROM (FROM saved EXCEPT FROM likes) UNION ALL SELECT 'hidden', user_id, url_key FROM (FROM hidden UNION FROM likes)")
def _(t):
    saved, hidden = merge.hide(t.saved(), t.hidden(), t.likes())
    return saved.select(F.lit("saved").alias("t"), "user_id", "url_key").union(hidden.select(F.lit("hidden"), "user_id", "url_key"))


@query("delete_by_key", "SELECT user_id, url_key FROM saved EXCEPT SELECT user_id, url_key FROM likes")
def _(t):
    return merge.delete_keys(t.saved(), t.likes(), ["user_id", "url_key"])


@query("account_rename", "SELECT DISTINCT CASE user_id WHEN '7' THEN '8' ELSE user_id END AS user_id, url_key FROM saved")
def _(t):
    return merge.rename_user(t.saved(), "7", "8")


@query("keep_newest_runs", "SELECT id, status FROM runs ORDER BY id DESC LIMIT 500")
def _(t):
    return merge.newest(t.runs(), 500).select("id", "status")


@query("ttl_popularity", f"SELECT url_key, arrival FROM popularity_log WHERE CAST(collected_at AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def _(t):
    log = t.popularity_log().withColumn("at", F.to_timestamp("collected_at"))
    return merge.within_days(log, "at", NOW, 10).select("url_key", "arrival")


@query("drop_done_attempts", "SELECT url_key, attempts FROM attempts WHERE url_key NOT IN (SELECT url_key FROM articles WHERE summary_quality = 'full')")
def _(t):
    done = t.articles().filter(F.col("summary_quality") == "full")
    return merge.delete_keys(t.attempts(), done, ["url_key"]).select("url_key", "attempts")


@query("stale_runs", "SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTE THEN 'error' ELSE status END AS status FROM runs")
def _(t):
    return control.stale_runs(t.runs(), "2024-01-15 00:00:00").select("id", "status")


@query("future_time_neutralise", "SELECT id, CASE WHEN TRY_CAST(published_at AS TIMESTAMP) > TIMESTAMP '2024-01-15 02:00:00' THEN '' ELSE published_at END AS published_at FROM articles")
def _(t):
    return t.articles().select("id", control.neutralised(F.col("published_at"), "2024-01-15 00:00:00").alias("published_at"))


@query("synthetic_noon", "SELECT id, CASE WHEN hour(when_ts) % 2 = 0 THEN strftime(when_ts, '%Y-%m-%d') ELSE strftime(when_ts, '%Y-%m-%dT%H:00:00.000Z') END AS shown FROM timed")
def _(t):
    from ..functions.times import shown_time

    rows = t.articles().select("id", effective_time(F.col("published_at"), F.col("fetched_at")).alias("w"))
    stamped = F.when(F.hour("w") % 2 == 0, F.date_format("w", "yyyy-MM-dd'T'03:00:00.000'Z'")).otherwise(F.date_format("w", "yyyy-MM-dd'T'HH:00:00.000'Z'"))
    return rows.select("id", F.when(F.hour("w") % 2 == 0, shown_time(stamped)).otherwise(stamped).alias("shown"))


@query("url_key_sha256", "SELECT page_id, sha256(url) AS url_key FROM pages")
def _(t):
    return t.read("pages").select("page_id", F.sha2("url", 256).alias("url_key"))


@query("time_repair_union", f"SELECT id FROM (SELECT id FROM articles WHERE published_at = '' UNION SELECT id FROM articles WHERE regexp_full_match(published_at, '.{{4}}-.{{2}}-.{{2}}') AND url_key NOT IN (SELECT url_key FROM checks))")
def _(t):
    a = t.articles()
    dated = a.filter(is_date_only(F.col("published_at"))).join(t.checks(), "url_key", "left_anti")
    return a.filter(F.col("published_at") == "").select("id").union(dated.select("id")).dropDuplicates(["id"])


@query("cursor_page", "SELECT id FROM articles WHERE id > 120 ORDER BY id LIMIT 25")
def _(t):
    return C.cursor_page(t.articles().select("id"), 120, 25)


@query("top_popularity_union", "SELECT kind, key, best, latest FROM (SELECT 'key' AS kind, url_key AS key, min(rank) AS best, max(collected_at) AS latest FROM popularity_log GROUP BY 2 UNION ALL SELECT 'title', title, min(rank), max(collected_at) FROM popular_items GROUP BY 2) ORDER BY best, latest DESC, kind, key LIMIT 12")
def _(t):
    return reports.top_popularity(t.popularity_log(), t.popular_items())


@query("status_totals", "SELECT count(*) AS total, max(fetched_at) AS latest_fetch, count(*) FILTER (WHERE summary_quality = 'full') AS published, count(*) FILTER (WHERE image_url <> '') AS with_image, count(*) FILTER (WHERE length(body_text) >= 300) AS with_body FROM articles")
def _(t):
    return reports.status_totals(t.articles())


@query("status_by_category", f"SELECT category, count(*) AS total, count(*) FILTER (WHERE summary_quality = 'full') AS published FROM timed WHERE when_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1")
def _(t):
    return reports.status_by_category(t.articles(), NOW)


@query("status_by_day", "SELECT left(coalesce(nullif(published_at, ''), fetched_at), 10) AS day, count(*) AS total FROM articles GROUP BY 1 ORDER BY 1 DESC LIMIT 31")
def _(t):
    return reports.status_by_day(t.articles())


@query(
    "status_recovery",
    """SELECT count(*) FILTER (WHERE q) AS waiting, count(*) FILTER (WHERE q AND n >= 300) AS body_ready, count(*) FILTER (WHERE q AND n BETWEEN 180 AND 299) AS body_thin, count(*) FILTER (WHERE q AND n < 180) AS body_short,
    count(*) FILTER (WHERE q AND a = 0) AS never_tried, count(*) FILTER (WHERE q AND a BETWEEN 1 AND 23) AS tried, count(*) FILTER (WHERE q AND a >= 24) AS exhausted
    FROM (SELECT summary_quality = 'none' AS q, length(body_text) AS n, coalesce(attempts, 0) AS a FROM articles LEFT JOIN attempts USING (url_key))""",
)
def _(t):
    return reports.status_recovery(t.articles(), t.attempts())


@query(
    "health_counts",
    f"""SELECT count(*) FILTER (WHERE d AND (category = '바둑' OR contains(title, '바둑') OR (contains(title, '기원') AND contains(summary, '바둑')))) AS baduk_24h, count(*) FILTER (WHERE d AND category <> '바둑') AS general_24h,
    count(*) FILTER (WHERE published_at = '') AS time_missing, count(*) FILTER (WHERE regexp_full_match(published_at, '.{{4}}-.{{2}}-.{{2}}') AND url_key NOT IN (SELECT url_key FROM checks)) AS date_only,
    count(*) FILTER (WHERE TRY_CAST(nullif(published_at, '') AS TIMESTAMP) > TIMESTAMP '{NOW}' + INTERVAL 2 HOUR) AS in_future, count(*) FILTER (WHERE contains(url, 'sports.naver.com')) AS broken_urls, max(strftime(when_ts, '%Y-%m-%d')) AS latest_day
    FROM (SELECT *, when_ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS d FROM timed)""",
)
def _(t):
    return reports.health_counts(t.articles(), t.checks(), NOW)


@query("run_diagnostics_rollup", "SELECT 'k' AS name, count(*) AS runs, CAST(sum(CAST(message->>'$.k' AS DOUBLE)) AS BIGINT) AS total FROM runs WHERE message->>'$.k' IS NOT NULL")
def _(t):
    return reports.run_diagnostics(t.runs())


@query("usage_storage", "SELECT (SELECT count(*) FROM articles) AS n_articles, (SELECT count(*) FROM saved) AS n_saved, (SELECT count(*) FROM runs) AS n_runs, CASE WHEN (SELECT count(*) FROM articles) % 100 >= 85 THEN 'danger' WHEN (SELECT count(*) FROM articles) % 100 >= 70 THEN 'warn' ELSE 'ok' END AS level")
def _(t):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return side_by_side(n(t.articles(), "n_articles"), n(t.saved(), "n_saved"), n(t.runs(), "n_runs")).withColumn("level", reports.storage_level(F.col("n_articles") % 100))


# --- budgets ------------------------------------------------------------------------------------------------


def _bucketed(t: Tables) -> DataFrame:
    return t.articles().select("id", F.when(F.col("category") == "fr", "baduk").otherwise("general").alias("bucket"), effective_time(F.col("published_at"), F.col("fetched_at")).alias("when_ts"))


_BUCKETS = ", b AS (SELECT id, CASE WHEN category = 'fr' THEN 'baduk' ELSE 'general' END AS bucket, when_ts, strftime(when_ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS kst_day FROM timed)"


@query("publish_counts", _BUCKETS + " SELECT bucket, count(*) AS this_month, count(*) FILTER (WHERE kst_day = '2024-01-20') AS today FROM b WHERE left(kst_day, 7) = '2024-01' GROUP BY 1")
def _(t):
    return control.publish_counts(_bucketed(t), "2024-01-20 01:00:00")


@query("publish_cap", _BUCKETS + " SELECT id, bucket, kst_day, place FROM (SELECT *, row_number() OVER (PARTITION BY bucket, kst_day ORDER BY when_ts, id) AS place FROM b) WHERE place <= 12")
def _(t):
    return control.capped_per_day(_bucketed(t)).select("id", "bucket", "kst_day", "place")


@query("call_budget_running", "SELECT event_id, used, used <= 44 AS fits FROM (SELECT event_id, CAST(sum(1 + event_id % 4) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ev)")
def _(t):
    calls = t.events().select("event_id", F.concat_ws("|", "user_id", F.to_date("ts")).alias("run"), (1 + F.col("event_id") % 4).alias("cost"))
    return control.within_budget(calls, order="event_id").select("event_id", "used", "fits")


@query("kst_day_tumbling", "SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS kst_day, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1")
def _(t):
    return control.tumbling_days(t.events())


@query("late_data_split", "SELECT CASE WHEN ts < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY THEN 'too_old' ELSE 'kept' END AS lateness, count(*) AS n FROM ev GROUP BY 1")
def _(t):
    return control.late_or_future(t.events(), "2024-02-10 00:00:00", "ts").groupBy("lateness").agg(F.count("*").alias("n"))


@query("daily_allowance", "SELECT event_id, CAST(floor(greatest(0, 4750000 - CAST(value * 10000 AS BIGINT)) / (31 - day(ts + INTERVAL 9 HOUR) + 1)) AS BIGINT) AS allowance FROM ev WHERE month(ts + INTERVAL 9 HOUR) = 1")
def _(t):
    e = t.events().withColumn("day", F.to_date(korea(F.col("ts")))).filter(F.month("day") == 1)
    spent = F.round(F.col("value") * 10000).cast("long")
    return e.select("event_id", daily_allowance(F.lit(fixed.MONTHLY_TARGET), spent, F.col("day")).cast("long").alias("allowance"))


@query("cost_micro_usd", "SELECT event_id, CASE event_type WHEN 'click' THEN CAST(ceil(user_id * 0.8 + event_id * 4.0) AS BIGINT) WHEN 'view' THEN CAST(ceil(user_id * 3.0 + event_id * 15.0) AS BIGINT) ELSE 0 END AS cost FROM ev")
def _(t):
    return t.events().select("event_id", cost_micro_usd(F.col("event_type"), F.col("user_id"), F.col("event_id"), {"click": (0.8, 4.0), "view": (3.0, 15.0)}).alias("cost"))


@query("spend_gate", "SELECT event_id, CASE WHEN m + 15000 > 5000000 THEN 'monthly' WHEN d + 15000 > 300000 THEN 'daily' ELSE '' END AS blocked_by FROM (SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m, sum(c) OVER (PARTITION BY user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS d FROM (SELECT *, 1000 * (event_id % 97) AS c FROM ev))")
def _(t):
    e = t.events().withColumn("c", 1000 * (F.col("event_id") % 97)).withColumn("day", korea_day(F.col("ts")))
    run = lambda *by: F.sum("c").over(Window.partitionBy(*by).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", control.spend_gate(run("user_id"), run("user_id", "day"), F.lit(15000)).alias("blocked_by"))


@query("host_failures", "SELECT host, count(*) AS fail FROM candidates WHERE size < 4000 GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    c = t.read("pages").select(host_c(F.col("url")).alias("host"), F.length("html").alias("size"))
    return c.filter("size < 4000").groupBy("host").agg(F.count("*").alias("fail")).filter("fail >= 2")


@query("host_quarantine")
def _(t):
    e = t.events().select(F.concat(F.lit("h"), F.col("user_id")).alias("host"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok"), F.when(F.col("event_type") == "error", "http_503").when(F.col("event_type") == "click", "http_404").otherwise("http_403").alias("status"))
    return control.quarantine(e)


# --- issues ------------------------------------------------------------------------------------------------


def _members(t: Tables) -> DataFrame:
    n, _ = t.counts
    a = t.articles().select("id", "url_key", "category", effective_time(F.col("published_at"), F.col("fetched_at")).alias("w"))
    k = F.when(F.col("id") % 11 == 0, F.concat("category", F.lit("|ai:misc"))).otherwise(F.concat("category", F.lit("|ai:"), F.col("id") % 40))
    title = F.when(F.col("id") % 40 % 3 == 0, F.concat(F.lit("대회 "), F.col("id") % 40)).otherwise(F.concat(F.lit("issue "), F.col("id") % 40))
    p = t.popularity().select("url_key", "score")
    rows = a.select("url_key", k.alias("key"), F.when(F.col("id") % 11 == 0, "기타").otherwise(title).alias("title"), (F.col("id") % 5).alias("related_count"), F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return rows.join(p, "url_key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


_ISSUES = """, members AS (SELECT url_key, CASE WHEN id % 11 = 0 THEN category || '|ai:misc' ELSE category || '|ai:' || (id % 40) END AS key,
    CASE WHEN id % 11 = 0 THEN '기타' WHEN id % 40 % 3 = 0 THEN '대회 ' || (id % 40) ELSE 'issue ' || (id % 40) END AS title, id % 5 AS related_count, strftime(when_ts, '%Y-%m-%d %H:%M:%S') AS moment FROM timed),
    counts AS (SELECT key, title, CAST(sum(1 + related_count) AS BIGINT) AS count, max(moment) AS latest, max(coalesce(score, 0)) AS score FROM members LEFT JOIN popularity USING (url_key) GROUP BY 1, 2)"""


@query("issue_counts", _ISSUES + " SELECT key, title, count, latest, score FROM counts")
def _(t):
    return issues.issue_counts(_members(t))


@query(
    "issue_tiles_capped",
    _ISSUES
    + """, ranked AS (SELECT *, key LIKE '%|ai:misc' AS misc, title LIKE '대회%' AND key NOT LIKE '%|ai:misc' AS tournament, row_number() OVER (PARTITION BY key LIKE '%|ai:misc', title LIKE '대회%' AND key NOT LIKE '%|ai:misc' ORDER BY score DESC, count DESC, latest DESC, key) AS n FROM counts),
    placed AS (SELECT *, row_number() OVER (PARTITION BY misc ORDER BY (tournament AND n <= 5) DESC, score DESC, count DESC, latest DESC, key) AS m FROM ranked)
    SELECT key, title, count, latest, score, row_number() OVER (ORDER BY misc, score DESC, latest DESC, key) AS shown FROM placed WHERE misc OR m <= 10""",
)
def _(t):
    return issues.tiles(issues.issue_counts(_members(t)), 10)


@query("issue_prune", _ISSUES + " SELECT key, count(*) AS n FROM members JOIN timed USING (url_key) WHERE when_ts >= TIMESTAMP '2024-01-20' GROUP BY key")
def _(t):
    cache = _members(t).groupBy("key").agg(F.collect_list("url_key").alias("url_keys")).select(F.lit("x").alias("category"), "key", F.lit("t").alias("title"), "url_keys")
    recent = t.articles().filter(effective_time(F.col("published_at"), F.col("fetched_at")) >= F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return issues.prune(cache, recent).select("key", F.size("url_keys").cast("long").alias("n"))


# --- repairs ------------------------------------------------------------------------------------------------


@query("title_repair", r" SELECT id, CASE WHEN id % 4 = 0 THEN title || ' x' WHEN length(title) < 5 AND starts_with('other', regexp_replace(title, '\s+', '', 'g')) THEN 'other' ELSE title END AS title FROM articles")
def _(t):
    a = t.articles()
    pages = a.select("url", F.when(F.col("id") % 4 == 0, F.concat("title", F.lit(" x"))).otherwise("other").alias("title"))
    return repairs.with_titles(a, pages).select("id", "title")


@query("time_repair", " SELECT id, CASE WHEN (published_at = '' OR regexp_full_match(published_at, '.{4}-.{2}-.{2}')) AND id % 2 = 0 THEN '2024-01-05T01:00:00.000Z' ELSE published_at END AS published_at FROM articles")
def _(t):
    a = t.articles()
    pages = a.select("url", F.when(F.col("id") % 2 == 0, "2024-01-05T01:00:00.000Z").otherwise("2024-01-05").alias("published_at"))
    return repairs.with_clocks(a, pages).select("id", "published_at")


@query("section_repair", f""", todo AS (SELECT * FROM timed WHERE category <> '바둑' AND summary_quality = 'full' AND when_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND url_key NOT IN (SELECT url_key FROM checks) ORDER BY when_ts DESC, id DESC LIMIT 10)
    SELECT id, category, CASE WHEN id % 2 = 0 THEN '경제' ELSE category END AS detected FROM todo""")
def _(t):
    a = t.articles()
    pages = a.select("url", F.when(F.col("id") % 2 == 0, "경제").otherwise("").alias("section"), F.lit("").alias("body"))
    return repairs.section_checks(a, t.checks(), pages, NOW).select("id", "category", "detected")


@query("popular_on_day", _BUCKETS + f" SELECT bucket, count(*) AS n FROM b JOIN articles a USING (id) WHERE kst_day = '2024-01-20' AND {_RANKED} GROUP BY 1")
def _(t):
    ranked = ranked_only(t.articles(), t.popularity(), t.popular_items()).select("id", F.lit(True).alias("is_popular"))
    return repairs.popular_on_day(_bucketed(t).join(ranked, "id"), "2024-01-20")


@query("url_repair", " SELECT id, CASE WHEN id % 3 = 0 THEN 'https://n.news.naver.com/mnews/article/001/' || id ELSE url END AS url FROM articles")
def _(t):
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://sports.naver.com/kbaseball/article/001/"), "id")).otherwise(F.col("url"))
    return t.articles().select("id", repairs.sports_url(url).alias("url"))


@query("acquired_pages", " SELECT id, CASE WHEN id % 3 = 0 THEN 'own' WHEN id % 3 = 1 AND regexp_matches(title, '[0-9A-Za-z가-힣]') THEN 'mirror' ELSE 'short' END AS used FROM articles")
def _(t):
    a = t.articles()
    kind = F.col("id") % 3
    pages = a.select("url", F.when(kind == 0, F.repeat(F.lit("b"), F.lit(400))).otherwise("").alias("body"), F.when(kind == 0, "ok").when(kind == 1, "http_403").otherwise("selector_miss").alias("status"))
    mirrors = a.filter(kind == 1).select(F.col("title").alias("query"), "title", F.concat(F.lit("https://m.example.com/"), "id").alias("url"))
    landed = pages.unionByName(mirrors.select("url", F.repeat(F.lit("m"), F.lit(200)).alias("body"), F.lit("ok").alias("status")))
    out = repairs.acquired(a.select("url", F.lit("").alias("link"), "title", "id"), landed, mirrors)
    used = F.when(F.col("body").startswith("b"), "own").when(F.col("body").startswith("m"), "mirror").otherwise("short")
    return out.join(a.select("url", "id"), "url").select("id", used.alias("used"))
