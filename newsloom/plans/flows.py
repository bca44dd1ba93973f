"""Queries over what runs do in turn: which model calls are made, and what comes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.times import effective_time, korea_day
from ..lineage import cut, new_folder
from ..operators import calls, diagnostics, merge, reports
from ..operators.issuecache import page_issues
from ..sources.store import Store
from ..streaming import joins, stateful
from . import relational, textual
from .standin import NOW, Tables, sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return f

    return keep


# --- budgets --------------------------------------------------------------------------------------------

#: Budgets of a size at which the events of an account meet each of them.
_BUDGET = {"general": 2, "total": 5, "cost": 15_000, "daily": 60_000, "monthly": 600_000}


@query(
    "calls_admitted",
    # one call after the other, all accounts at once
    f""", c AS (SELECT event_id AS ordinal, user_id % 50 AS account, event_type = 'click' AS go, ts + INTERVAL 9 HOUR AS korea, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM ev),
    folded AS (WITH RECURSIVE fold AS (SELECT DISTINCT account, 0::BIGINT AS k, 0::BIGINT AS ordinal, NULL::DATE AS day, 0 AS called, 0 AS spent, 0 AS month, ''::VARCHAR AS reason FROM c
        UNION ALL SELECT account, k, ordinal, day, called + CASE WHEN calls THEN 1 ELSE 0 END, spent + CASE WHEN calls AND why = '' THEN {_BUDGET["cost"]} ELSE 0 END, month + CASE WHEN calls AND why = '' THEN {_BUDGET["cost"]} ELSE 0 END, CASE WHEN calls THEN why ELSE 'calls' END
            FROM (SELECT *, called < {_BUDGET["general"]} OR (called < {_BUDGET["total"]} AND (go OR hour(korea) >= 21)) AS calls, CASE WHEN month + {_BUDGET["cost"]} > {_BUDGET["monthly"]} THEN 'monthly' WHEN spent + {_BUDGET["cost"]} > {_BUDGET["daily"]} THEN 'daily' ELSE '' END AS why
                FROM (SELECT c.*, CAST(c.korea AS DATE) AS day, CASE WHEN f.day = CAST(c.korea AS DATE) THEN f.called ELSE 0 END AS called, CASE WHEN f.day = CAST(c.korea AS DATE) THEN f.spent ELSE 0 END AS spent, CASE WHEN date_trunc('month', f.day) = date_trunc('month', CAST(c.korea AS DATE)) THEN f.month ELSE 0 END AS month
                    FROM fold f JOIN c ON c.account = f.account AND c.k = f.k + 1)))
        SELECT * FROM fold WHERE k > 0)
    SELECT account, ordinal, reason FROM folded""",
)
def _(t):
    e = t.events().select((F.col("user_id") % 50).alias("account"), F.col("event_id").alias("ordinal"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "baduk").otherwise("general").alias("bucket"))
    return calls.admitted(e, ("account",), **_BUDGET).select("account", "ordinal", "reason")


# --- calls ----------------------------------------------------------------------------------------------


def _asked(t: Tables) -> DataFrame:
    """Articles, clean titles, with the run that collects them: a quarter of a day."""
    at = effective_time(F.col("published_at"), F.col("fetched_at"))
    rows = t.articles().select("id", "url_key", X.clean_title_c(F.col("title")).alias("title"), "summary_quality", at.alias("at")).withColumn("day", korea_day(F.col("at")))
    return rows.withColumn("run", F.concat(F.date_format("at", "yyyy-MM-dd "), F.floor(F.hour("at") / 6)))


def judged_runs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates of runs that may call, known stories, questions): articles without a summary against those that have one."""
    rows = _asked(t)
    new = rows.filter(F.col("summary_quality") != "full")
    runs = new.groupBy("run").agg(F.min("at").alias("at")).select("run", "at", F.unix_timestamp("at").alias("ordinal"), F.lit("general").alias("bucket"))
    may = calls.admitted(runs, general=3, total=3).filter("reason = ''").select("run")
    new, known = new.join(may, "run", "left_semi"), rows.filter(F.col("summary_quality") == "full")
    return new, known, calls.duplicate_questions(new, known)


@query("duplicates_judged")
def _(t):
    return calls.model_call(judged_runs(t)[2], "duplicates").select("run", "id", "same_id")


def standalone_titles(t: Tables, most: int = 12) -> DataFrame:
    """Rows for model_call: of each day the articles with the best popularity."""
    rows = _asked(t).join(t.popularity().select("url_key", "rank", "score"), "url_key")
    place = F.row_number().over(Window.partitionBy("day").orderBy("rank", F.desc("score"), "id")).cast("long")
    return rows.withColumn("place", place).filter(F.col("place") <= most).select(F.col("day").alias("run"), F.lit("new").alias("kind"), "place", "id", "title")


@query("titles_rewritten")
def _(t):
    return calls.model_call(standalone_titles(t), "titles").select("run", "id", "title")


# --- streams --------------------------------------------------------------------------------------------


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as it lands: all its files at once, so that order within them is the order of time."""
    schema = t.read(name).schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")  # as a pattern, for a table may be one file
    return rows.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))


def _to_end(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder = new_folder(t.spark, name)
    return stateful.run_to_files(stream, f"{folder}/rows", f"{folder}/checkpoint")


def _landing(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """A stream of rows with a time ts, as they land in a folder of their own, and the row that ends it."""
    folder = new_folder(t.spark, name)
    rows.write.parquet(folder)
    joins.closing_row(t.spark.read.schema(rows.schema).parquet(folder)).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).parquet(folder)


def _run_out(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder = new_folder(t.spark, name)
    return joins.run_out(stream, f"{folder}/rows", f"{folder}/checkpoint")


def _dated_articles(t: Tables) -> DataFrame:
    return t.articles().select("id", "url_key", "summary_quality", effective_time(F.col("published_at"), F.col("fetched_at")).alias("ts"))


def _settled_attempts(t: Tables) -> DataFrame:
    return t.attempts().withColumnRenamed("last_attempt", "ts")


@query("attempts_joined_stream", " SELECT id, coalesce(attempts, 0) AS attempts FROM articles LEFT JOIN attempts USING (url_key)")
def _(t):
    articles, attempts = _landing(t, _dated_articles(t), "landed-articles"), _landing(t, _settled_attempts(t), "landed-attempts")
    return _run_out(t, joins.attempts_of_articles(articles, attempts), "attempts-joined")


@query("attempts_open_stream", " SELECT url_key, attempts FROM attempts WHERE url_key NOT IN (SELECT url_key FROM articles WHERE summary_quality = 'full')")
def _(t):
    done = _dated_articles(t).filter(F.col("summary_quality") == "full").select("url_key", "ts")
    return _run_out(t, joins.attempts_not_done(_landing(t, _settled_attempts(t), "landed-attempts"), _landing(t, done, "landed-done")), "attempts-open")


@query("publish_cap_stream", " SELECT id, bucket, kst_day, CAST(place AS INTEGER) AS place FROM (SELECT event_id AS id, event_type AS bucket, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS kst_day, row_number() OVER (PARTITION BY event_type, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') ORDER BY ts, event_id) AS place FROM ev) WHERE place <= 12")
def _(t):
    rows = _stream(t, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("bucket"), "ts")
    return _to_end(t, stateful.publish_cap(rows), "publish-cap")


@query(
    "retry_gate_stream",
    f""", r AS (SELECT event_id AS id, 'u' || user_id AS url_key, ts, event_type = 'signup' AS published, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ev),
    folded AS (WITH RECURSIVE fold AS (SELECT DISTINCT url_key, 0::BIGINT AS k, 0::BIGINT AS id, NULL::TIMESTAMP AS last, 0 AS tries, ''::VARCHAR AS what FROM r
        UNION ALL SELECT url_key, k, id, CASE what WHEN 'tried' THEN ts WHEN 'published' THEN NULL ELSE last END, CASE what WHEN 'tried' THEN tries + 1 WHEN 'published' THEN 0 ELSE tries END, what
            FROM (SELECT r.*, f.last, f.tries, CASE WHEN published THEN 'published' WHEN tries >= {stateful.TRIES} THEN 'spent' WHEN r.ts < f.last + INTERVAL {stateful.HOURS} HOUR THEN 'held' ELSE 'tried' END AS what FROM fold f JOIN r ON r.url_key = f.url_key AND r.k = f.k + 1))
        SELECT * FROM fold WHERE k > 0)
    SELECT url_key, id, what, tries FROM folded""",
)
def _(t):
    rows = _stream(t, "events").select(F.concat(F.lit("u"), "user_id").alias("url_key"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "signup").alias("published"))
    return _to_end(t, stateful.retry_gate(rows), "retry-gate").filter("id is not null").select("url_key", "id", "what", "tries")


@query("cursor_slots_stream", " SELECT event_type AS cursor, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS slot FROM ev")
def _(t):
    rows = _stream(t, "events").select(F.col("event_type").alias("cursor"), F.col("event_id").alias("id"), "ts")
    folder = new_folder(t.spark, "cursors")
    return stateful.cursors_to_files(rows, f"{folder}/rows", f"{folder}/checkpoint").select("cursor", "id", "slot")


# --- stores ---------------------------------------------------------------------------------------------


@query("article_store", relational.ARTICLE_UPSERT)
def _(t):
    """Upserts into a store: what is there, then what comes, which then comes again."""
    old, new = relational.changed_articles(t)
    store = Store(t.spark, new_folder(t.spark, "articles"), old.schema, ["url_key"], parts=16)
    for n, batch in ((0, old), (1, new), (1, new)):
        store.apply(batch, n, merge.upsert_articles)
    return store.read().select("id", "title", "summary_quality", F.length("body_text").alias("body_length"), F.length("summary").alias("summary_length"))


@query("popularity_store", f" SELECT url_key, score, rank, source, collected_at FROM popularity WHERE CAST(collected_at AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def _(t):
    """The log in three batches, of which the second comes twice, then what is older than ten days goes."""
    log = t.popularity_log()
    third = -(-t.counts[1] // 3)
    store = Store(t.spark, new_folder(t.spark, "popularity"), log.schema, ["url_key"], parts=16)
    for n in (0, 1, 1, 2):
        batch = log.filter((F.col("arrival") >= n * third) & (F.col("arrival") < (n + 1) * third))
        store.apply(batch, n, lambda old, new: merge.popularity_live(old.unionByName(new)))
    store.expire(F.to_timestamp("collected_at") < F.to_timestamp(F.lit(NOW)) - F.expr("interval 10 days"), 3)
    return store.read().select("url_key", "score", "rank", "source", "collected_at")


# --- diagnostics ----------------------------------------------------------------------------------------

#: A run's message, in words that both engines know: of drifting shape, some without diagnostics, some that can't be read.
_MESSAGE = """CASE WHEN event_id % 17 = 0 THEN 'diagnostics {' WHEN event_id % 13 = 0 THEN '{"warnings":["diagnostics"]}' WHEN event_id % 11 = 0 THEN '["diagnostics"]' ELSE
    '{"diagnostics":{"mode":"' || CASE WHEN user_id % 3 = 0 THEN 'scheduled' ELSE 'backfill' END || '","summary_rejected_by_rule":{"short":' || CAST(event_id % 5 AS STRING) || ',"promo":"' || CAST(event_id % 3 AS STRING) || '"},'
    || CASE WHEN event_id % 2 = 0 THEN '"subrequests_used":' || CAST(event_id % 44 AS STRING) || ',' ELSE '' END
    || '"body_too_short_hosts":{"baduk:a.kr|http_403":' || CAST(event_id % 4 AS STRING) || CASE WHEN event_id % 5 = 0 THEN ',"general:b.kr|error_Too many Subrequests":1' ELSE '' END || '},'
    || CASE WHEN event_id % 3 = 0 THEN '"anthropic_exhausted_reason":"' || CASE WHEN user_id % 2 = 0 THEN 'daily_total' ELSE 'bucket_general' END || '","anthropic_calls_by_bucket":{"baduk":' || CAST(event_id % 60 AS STRING) || '},' ELSE '' END
    || '"processed_by_category":{"baduk":' || CAST(user_id % 4 AS STRING) || ',"general":{"x":{"y":' || CAST(event_id % 7 AS STRING) || '}}},"candidate_outcomes_by_category":{"general":{}'
    || CASE WHEN event_id % 4 <> 0 THEN ',"baduk":{"body_too_short":' || CAST(event_id % 3 AS STRING) || ',"inserted_publishable":' || CAST(user_id % 2 AS STRING) || ',"existing_repaired":null}' ELSE '' END || '}}}' END"""
_RUN_STATUS = "CASE WHEN user_id % 5 = 0 THEN 'error' WHEN user_id % 5 = 1 THEN 'running' WHEN user_id % 5 = 2 THEN 'degraded' ELSE 'ok' END"
_RUNS_SQL = f""", told AS (SELECT event_id AS id, ts AS started_at, {_RUN_STATUS} AS status, CASE WHEN user_id % 5 <> 1 THEN ts + INTERVAL 5 MINUTE END AS finished_at, {_MESSAGE} AS message FROM ev WHERE event_type = 'error'),
    read AS (SELECT *, TRY_CAST(message AS JSON) AS j FROM told)"""


def diagnosed_runs(t: Tables) -> DataFrame:
    e = t.events("error")
    finished = F.when(F.col("user_id") % 5 != 1, F.col("ts") + F.expr("interval 5 minutes"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.expr(_RUN_STATUS).alias("status"), finished.alias("finished_at"), F.expr(_MESSAGE).alias("message"))


@query(
    "run_leaves",
    _RUNS_SQL + """ SELECT replace(t.fullkey, '"', '') AS path, count(DISTINCT r.id) AS runs, round(sum(CAST(t.atom AS DOUBLE)), 4) AS total FROM (SELECT * FROM read WHERE json_type(j) = 'OBJECT') r, json_tree(r.j) t
    WHERE t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND NOT contains(t.fullkey, '[') GROUP BY 1""",
)
def _(t):
    return diagnostics.leaves(diagnosed_runs(t))


@query("summary_rejections", _RUNS_SQL + " SELECT rule, CAST(sum(coalesce(TRY_CAST(j->'$.diagnostics.summary_rejected_by_rule'->>rule AS DOUBLE), 0)) AS BIGINT) AS n FROM (SELECT j, unnest(json_keys(j, '$.diagnostics.summary_rejected_by_rule')) AS rule FROM read WHERE json_type(j) = 'OBJECT') GROUP BY 1")
def _(t):
    return diagnostics.rejections(diagnosed_runs(t))


_HEALTH_AT = "2024-01-28 00:00:00"


def _figure_sql(path: str) -> str:
    return f"coalesce(TRY_CAST(j->>'$.diagnostics.{path}' AS DOUBLE), 0)"


_BADUK_SQL = _figure_sql("candidate_outcomes_by_category.baduk.{0}").format
_FIGURES_SQL = (
    _RUNS_SQL
    + f""", go AS (SELECT * REPLACE (CASE WHEN category = 'fr' THEN '바둑' ELSE category END AS category) FROM timed),
    late AS (SELECT * FROM (SELECT * FROM read WHERE started_at >= TIMESTAMP '{_HEALTH_AT}' - INTERVAL 24 HOUR AND contains(message, 'diagnostics') ORDER BY id DESC LIMIT 30) WHERE (j->'$.diagnostics') IS NOT NULL),
    sums AS (SELECT count(*) FILTER (WHERE (j->>'$.diagnostics.anthropic_exhausted_reason') IN ('bucket_baduk', 'daily_total') AND {_figure_sql("processed_by_category.baduk")} > 0 AND {_figure_sql("anthropic_calls_by_bucket.baduk")} < {fixed.RESERVED_CALLS}) AS quota_blocked,
        coalesce(sum({_figure_sql("processed_by_category.baduk")}), 0) AS baduk_seen, coalesce(sum({_BADUK_SQL("body_too_short")}), 0) AS baduk_short, coalesce(sum({_BADUK_SQL("inserted_publishable")} + {_BADUK_SQL("existing_repaired")}), 0) AS baduk_published FROM late),
    over AS (SELECT count(*) AS budget_exceeded FROM (SELECT unnest(json_keys(j, '$.diagnostics.body_too_short_hosts')) AS k FROM late WHERE (j->'$.diagnostics.subrequests_used') IS NOT NULL) WHERE k ILIKE '%too many subrequests%'),
    turned AS (SELECT coalesce(sum(coalesce(TRY_CAST(j->'$.diagnostics.summary_rejected_by_rule'->>rule AS DOUBLE), 0)), 0) AS rejected FROM (SELECT j, unnest(json_keys(j, '$.diagnostics.summary_rejected_by_rule')) AS rule FROM late)),
    age AS (SELECT *, (epoch(TIMESTAMP '{_HEALTH_AT}') - epoch(started_at)) / 3600 AS started, (epoch(TIMESTAMP '{_HEALTH_AT}') - epoch(finished_at)) / 3600 AS finished FROM read),
    last AS (SELECT status, started, finished FROM age ORDER BY id DESC LIMIT 1),
    automatic AS (SELECT arg_max(finished, id) FILTER (WHERE finished IS NOT NULL) AS hours FROM age WHERE (j->>'$.diagnostics.mode') = 'scheduled'),
    fresh AS (SELECT * FROM go WHERE summary_quality = 'full' AND when_ts >= TIMESTAMP '{_HEALTH_AT}' - INTERVAL 24 HOUR),
    paid AS (SELECT id, strftime(when_ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, list_filter(list_distinct(regexp_extract_all(title, '[0-9A-Za-z가-힣]{{2,}}')), lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({textual._STOP})) AS w FROM fresh WHERE category <> '바둑' ORDER BY id DESC LIMIT 60),
    pairs AS (SELECT count(*) AS n FROM paid a JOIN paid b ON a.day = b.day AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 3),
    stored AS (SELECT count(*) AS n FROM fresh WHERE category = '바둑'),
    good AS (SELECT count(*) AS n FROM (SELECT id FROM fresh WHERE category = '바둑' AND {relational._QUALITY} LIMIT 60)),
    state AS (SELECT (SELECT strftime(max(ts), '%Y-%m-%d') FROM ev WHERE event_type = 'view') AS source_day, (SELECT count(*) FROM ev) AS reads, (SELECT count(*) * 50000 FROM documents) AS bytes, (SELECT CAST(sum(floor(value)) AS BIGINT) FROM ev WHERE event_type = 'purchase') AS spent),
    counts AS (SELECT count(*) FILTER (WHERE when_ts >= TIMESTAMP '{_HEALTH_AT}' - INTERVAL 24 HOUR AND category <> '바둑') AS general, count(*) FILTER (WHERE published_at = '') AS missing,
        count(*) FILTER (WHERE regexp_full_match(published_at, '.{{4}}-.{{2}}-.{{2}}') AND url_key NOT IN (SELECT url_key FROM checks)) AS date_only,
        count(*) FILTER (WHERE TRY_CAST(nullif(published_at, '') AS TIMESTAMP) > TIMESTAMP '{_HEALTH_AT}' + INTERVAL 2 HOUR) AS ahead, count(*) FILTER (WHERE contains(url, 'sports.naver.com')) AS broken,
        max(strftime(when_ts, '%Y-%m-%d')) FILTER (WHERE category = '바둑' AND summary_quality = 'full' AND contains(url, '{fixed.TIMELESS_HOST}')) AS stored_day FROM go),
    spent AS (SELECT count(*) FILTER (WHERE summary_quality = 'none' AND coalesce(attempts, 0) >= 24) AS exhausted FROM articles LEFT JOIN attempts USING (url_key))
    SELECT coalesce(last.status IN ('ok', 'degraded') OR (last.status = 'running' AND started <= 0.25), FALSE) AS last_run_ok, coalesce(CASE WHEN last.status = 'running' AND started <= 0.25 THEN started ELSE finished END <= 6, FALSE) AS last_run_within_6h,
        coalesce(hours <= 4, FALSE) AS automatic_run_within_4h, general > 0 AS general_has_recent_news, coalesce(source_day IS NULL OR stored_day >= source_day, FALSE) AS baduk_source_collected, baduk_short < 6 OR baduk_published > 0 AS baduk_body_fetch_healthy,
        baduk_seen = 0 AS baduk_reaches_screen, budget_exceeded = 0 AS subrequest_budget_respected, broken = 0 AS stored_urls_openable, pairs.n < 2 AS duplicate_paid_summaries_low, missing <= 3 AS published_time_healthy, date_only <= 5 AS published_time_has_clock,
        ahead = 0 AS published_time_not_future, quota_blocked < 3 AS baduk_ai_quota_available, rejected < 10 OR baduk_published > 0 AS paid_summary_reaches_screen,
        -- no stand-in is about Go in its words, so the screen takes all that the rules leave
        good.n + CASE WHEN stored.n > 60 THEN 0 ELSE stored.n - good.n END < 2 AS baduk_display_not_over_filtered, TRUE AS cloudflare_not_provider_blocked, state.spent < 5000000 AS claude_under_hard_limit,
        exhausted < 15 AS summary_exhausted_below_threshold, reads < 1000000 AS d1_reads_under_daily_limit, bytes / 524288000 * 100 < 70 AS database_storage_below_70_percent
    FROM sums, over, turned, last, automatic, pairs, stored, good, state, counts, spent"""
)


def health(t: Tables) -> DataFrame:
    """The 21 checks at _HEALTH_AT; French stands in for Go, and what the state holds is counted from the tables."""
    articles = t.articles().withColumn("category", F.when(F.col("category") == "fr", "바둑").otherwise(F.col("category")))
    e = t.events()
    told = diagnostics.side_by_side(
        e.agg(F.date_format(F.max(F.when(F.col("event_type") == "view", F.col("ts"))), "yyyy-MM-dd").alias("baduk_source_latest"), F.count("*").alias("d1_rows_read"), F.sum(F.when(F.col("event_type") == "purchase", F.floor("value"))).alias("claude_monthly_micro_usd")),
        t.read("documents").agg((F.count("*") * 50000).alias("database_bytes")),
    )
    state = told.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in told.columns])).alias("s")).select("s.*")
    return reports.health_checks(diagnostics.health_figures(articles, t.attempts(), t.checks(), diagnosed_runs(t), state, _HEALTH_AT))


@query("health_checks", _FIGURES_SQL)
def _(t):
    return health(t).drop("failures")


# --- issues from the cache ------------------------------------------------------------------------------

_BUILT = ("2024-01-29 00:00:00", "2024-01-29 18:00:00", "2024-01-31 06:00:00")
_ASKED_AT = ("2024-01-29 12:00:00", "2024-01-31 00:00:00")


def issue_history(t: Tables) -> DataFrame:
    """Payloads of three times, each of the 400 articles before it, by source; the last one can't be read, and an empty one of
    another category stands beside."""
    rows = textual._recent_rows(t)
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    rest = number >= 17
    out = t.spark.createDataFrame([("다른", 9, "[]", _BUILT[0]), ("일반", 8, "{broken", _BUILT[2])], "category string, id long, payload string, built_at string")
    for i, at in enumerate(_BUILT[:2]):
        some = rows.filter(F.col("w") < F.to_timestamp(F.lit(at))).orderBy(F.desc("w"), "id").limit(400)
        groups = some.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("w")).alias("o"), "id", "url_key"))), lambda x: x["url_key"]).alias("url_keys"))
        title = F.when(rest, "기타").otherwise(F.concat(F.lit("tournament"), number % 7, F.when(number % 2 == 0, " 배 ").otherwise(" "), "source"))
        one = groups.select(F.struct(F.when(rest, "일반|ai:misc").otherwise(F.concat(F.lit("일반|ai:"), number)).alias("key"), title.alias("title"), "url_keys").alias("g"), number.alias("k"))
        payload = one.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda x: x["g"])).alias("payload"))
        out = out.unionByName(payload.select(F.lit("일반").alias("category"), F.lit(i).cast("long").alias("id"), "payload", F.lit(at).alias("built_at")))
    return out.withColumn("built_at", F.to_timestamp("built_at"))


def page_cards(t: Tables) -> DataFrame:
    """The newest 400 articles as cards."""
    rows = textual._recent_rows(t).orderBy(F.desc("w"), "id").limit(400)
    score = t.popularity().select("url_key", "score")
    rows = rows.join(score, "url_key", "left")
    order = F.row_number().over(Window.orderBy(F.desc("w"), "id"))
    return rows.select(order.alias("ord"), "url_key", F.lit("일반").alias("category"), "title", "summary", (F.col("id") % 3).cast("int").alias("related_count"), F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _issues_sql(asked: str, built: str) -> str:
    return f"""SELECT '{asked}' AS asked, t.* FROM (WITH cut AS (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS k FROM timed WHERE when_ts < TIMESTAMP '{built}' ORDER BY when_ts DESC, id LIMIT 400),
        cards AS (SELECT id, url_key, id % 3 AS related, strftime(when_ts, '%Y-%m-%d %H:%M:%S') AS moment, coalesce(score, 0) AS score FROM (SELECT * FROM timed ORDER BY when_ts DESC, id LIMIT 400) LEFT JOIN popularity USING (url_key)),
        heads AS (SELECT k % 7 AS event, min(k) AS k FROM cut WHERE k < 17 GROUP BY 1),
        members AS (SELECT CASE WHEN c.k >= 17 THEN '일반|ai:misc' ELSE '일반|ai:' || h.k END AS key, CASE WHEN c.k >= 17 THEN '기타' ELSE 'tournament' || h.event || CASE WHEN h.k % 2 = 0 THEN ' 배 ' ELSE ' ' END || 'src' || h.k END AS title, d.*
            FROM cut c JOIN cards d USING (url_key) LEFT JOIN heads h ON h.event = c.k % 7),
        counts AS (SELECT key, title, CAST(sum(1 + related) AS BIGINT) AS count, max(moment) AS latest, max(score) AS score FROM members GROUP BY 1, 2),
        ranked AS (SELECT *, key LIKE '%|ai:misc' AS misc, contains(title, '배') AS tournament, row_number() OVER (PARTITION BY key LIKE '%|ai:misc', contains(title, '배') ORDER BY score DESC, count DESC, latest DESC, key) AS n FROM counts),
        placed AS (SELECT *, row_number() OVER (PARTITION BY misc ORDER BY (tournament AND n <= 2) DESC, score DESC, count DESC, latest DESC, key) AS m FROM ranked)
        SELECT key, title, count, latest, score, row_number() OVER (ORDER BY misc, score DESC, latest DESC, key) AS shown FROM placed WHERE misc OR m <= 4) t"""


@query("issues_from_cache", " " + " UNION ALL ".join(map(_issues_sql, _ASKED_AT, _BUILT)))
def _(t):
    cards, history = cut(page_cards(t)), cut(issue_history(t))
    one, other = [page_issues(cards, history, "일반", at, 4).select(F.lit(at).alias("asked"), "key", "title", "count", "latest", "score", "shown") for at in _ASKED_AT]
    return one.unionByName(other)
