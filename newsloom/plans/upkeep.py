"""Queries over stored state, accounts, limits and candidates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.times import effective_time, korea_day, korea_month
from ..operators import candidates as C
from ..operators import merge, upkeep
from .standin import NOW, Tables, sql
from .textual import rejects_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        ORACLE[name] = sql(oracle)
        return f

    return keep


_STATE = f""", state AS (SELECT '{fixed.READ_LEDGER}' || strftime(ts, '%Y-%m-%d') AS key, count(*) AS value FROM ev GROUP BY 1
    UNION ALL SELECT 'of ' || event_type, count(*) FROM ev GROUP BY 1)"""


def _state(t: Tables) -> DataFrame:
    e = t.events()
    days = e.groupBy(F.concat(F.lit(fixed.READ_LEDGER), F.date_format("ts", "yyyy-MM-dd")).alias("key")).agg(F.count("*").alias("value"))
    return days.unionByName(e.groupBy(F.concat(F.lit("of "), "event_type").alias("key")).agg(F.count("*").alias("value")))


@query("read_ledger", _STATE + f" SELECT key, value FROM state WHERE key NOT LIKE '{fixed.READ_LEDGER}%' OR key >= '{fixed.READ_LEDGER}2024-01-18'")
def _(t):
    return upkeep.ledger_kept(_state(t), "2024-01-25")


@query("state_scan", _STATE + " SELECT max(value) FILTER (WHERE key = 'of click') AS \"of click\", max(value) FILTER (WHERE key = 'of view') AS \"of view\", max(value) FILTER (WHERE key = 'of error') AS \"of error\" FROM state")
def _(t):
    return upkeep.state_values(_state(t), ["of click", "of view", "of error"])


@query("runs_by_cutoff", " SELECT id, status FROM runs WHERE id > coalesce((SELECT id FROM runs ORDER BY id DESC LIMIT 1 OFFSET 120), -1)")
def _(t):
    return upkeep.newest_by_cutoff(t.runs(), 120).select("id", "status")


@query(
    "recent_diagnostics",
    f""", r AS (SELECT CAST(message->>'$.k' AS DOUBLE) AS k FROM runs WHERE started_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR ORDER BY id DESC LIMIT 30)
    SELECT 'rejected.k' AS name, count(k) AS runs, CAST(sum(k) AS BIGINT) AS total FROM r HAVING count(k) > 0 UNION ALL SELECT 'runs', count(*), count(*) FROM r HAVING count(*) > 0""",
)
def _(t):
    message = F.concat(F.lit('{"rejected":'), "message", F.lit(',"runs":1,"mode":"auto"}'))
    return upkeep.recent_diagnostics(t.runs().withColumn("message", message), NOW)


@query("noon_downgrade", " SELECT id, CASE WHEN day = '2024-01-15' THEN day ELSE day || 'T12:00:00.000Z' END AS published_at FROM (SELECT id, strftime(when_ts, '%Y-%m-%d') AS day FROM timed)")
def _(t):
    noon = F.date_format(effective_time(F.col("published_at"), F.col("fetched_at")), "yyyy-MM-dd'T12:00:00.000Z'")
    return t.articles().select("id", upkeep.noon_downgraded(noon, "2024-01-15").alias("published_at"))


@query(
    "time_repair_batch",
    f""", near AS (SELECT * FROM timed WHERE when_ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAY),
    a AS (SELECT id FROM near WHERE id > 40 AND summary_quality = 'full' AND url NOT LIKE '%{fixed.TIMELESS_HOST}%' AND (trim(published_at) = '' OR regexp_full_match(published_at, '.{{4}}-.{{2}}-.{{2}}')) AND url_key NOT IN (SELECT url_key FROM checks) ORDER BY id LIMIT 25),
    b AS (SELECT id FROM near WHERE TRY_CAST(published_at AS TIMESTAMP) > TIMESTAMP '2024-01-20 02:00:00' ORDER BY id LIMIT 25)
    SELECT id FROM (SELECT id FROM a UNION SELECT id FROM b) ORDER BY id LIMIT 25""",
)
def _(t):
    return upkeep.time_repair_batch(t.articles(), t.checks(), "2024-01-20 00:00:00", 40, 25).select("id")


_USERS = ", users AS (SELECT 'u' || (user_id % 20) AS username, 'hash' AS password_hash, 'admin' AS role, 1 AS active, '' AS updated_at FROM ev GROUP BY 1), mine AS (SELECT event_type, 'account:u' || (CAST(user_id AS BIGINT) % 20) AS user_id, url_key FROM marks GROUP BY 1, 2, 3)"


def _users(t: Tables) -> DataFrame:
    return t.events().select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("username")).distinct().select("username", F.lit("hash").alias("password_hash"), F.lit("admin").alias("role"), F.lit(1).alias("active"), F.lit("").alias("updated_at"))


def _mine(t: Tables, marks: DataFrame) -> DataFrame:
    return marks.select(F.concat(F.lit("account:u"), F.col("user_id").cast("long") % 20).alias("user_id"), "url_key").distinct()


def _account(saved: DataFrame, hidden: DataFrame, users: DataFrame) -> DataFrame:
    tell = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[F.col(x).cast("string").alias(n) for x, n in zip(c, ("name", "a", "b"))])
    return tell(saved, "saved", "user_id", "url_key", "user_id").union(tell(hidden, "hidden", "user_id", "url_key", "user_id")).union(tell(users, "user", "username", "role", "active"))


@query(
    "account_delete",
    _USERS
    + """ SELECT CASE event_type WHEN 'click' THEN 'saved' ELSE 'hidden' END AS kind, user_id AS name, url_key AS a, user_id AS b FROM mine WHERE event_type IN ('click', 'error') AND user_id <> 'account:u3'
    UNION ALL SELECT 'user', username, role, CASE username WHEN 'u3' THEN '0' ELSE '1' END FROM users UNION ALL SELECT 'user', 'stranger', 'member', '0'""",
)
def _(t):
    saved, hidden, users = upkeep.account_deleted(_mine(t, t.saved()), _mine(t, t.hidden()), _users(t), "u3", NOW)
    return _account(saved, hidden, upkeep.tombstone(users, "stranger", NOW))


@query(
    "account_move",
    _USERS
    + """ SELECT DISTINCT CASE event_type WHEN 'click' THEN 'saved' ELSE 'hidden' END AS kind, replace(user_id || ';', ':u3;', ':u4;')[:-2] AS name, url_key AS a, replace(user_id || ';', ':u3;', ':u4;')[:-2] AS b FROM mine WHERE event_type IN ('click', 'error')
    UNION ALL SELECT 'user', username, role, CASE username WHEN 'u3' THEN '0' ELSE '1' END FROM users WHERE username <> 'u4' UNION ALL SELECT 'user', 'u4', 'member', '1'""",
)
def _(t):
    # the marks of u4 are there already, its account is made by the move
    saved, hidden, users = upkeep.account_moved(_mine(t, t.saved()), _mine(t, t.hidden()), _users(t).filter("username <> 'u4'"), "u3", "u4", "hash", NOW)
    return _account(saved, hidden, users)


@query("valid_accounts", " SELECT event_id, regexp_full_match(n, '[a-z0-9._-]{3,32}') AS name_ok, length(p) BETWEEN 4 AND 64 AS password_ok FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '.' || user_id WHEN 1 THEN upper(event_type) WHEN 2 THEN left(event_type, 2) ELSE repeat(event_type, event_id % 9) END AS n, props AS p FROM ev)")
def _(t):
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.concat_ws(".", "event_type", "user_id")).when(i % 4 == 1, F.upper("event_type")).when(i % 4 == 2, F.left("event_type", F.lit(2))).otherwise(F.expr("repeat(event_type, cast(event_id % 9 as int))"))
    return t.events().select("event_id", upkeep.valid_username(name).alias("name_ok"), upkeep.valid_password(F.col("props")).alias("password_ok"))


@query(
    "limits_of_days",
    f" SELECT event_id, CASE strftime(k, '%Y-%m-%d') WHEN '2024-01-09' THEN 500000 ELSE {fixed.DAILY_SPEND} END AS spend, CASE strftime(k, '%Y-%m') WHEN '2024-02' THEN 7000000 ELSE {fixed.MONTHLY_SPEND} END AS month_spend, {fixed.DAILY_CALLS} AS calls FROM (SELECT event_id, ts + INTERVAL 9 HOUR + INTERVAL 5 DAY AS k FROM ev)",
)
def _(t):
    at = F.col("ts") + F.expr("interval 5 days")
    day, month = korea_day(at), korea_month(at)
    spend, total = upkeep.limit_of(day, {"2024-01-09": 500_000}, fixed.DAILY_SPEND), upkeep.limit_of(month, {"2024-02": 7_000_000}, fixed.MONTHLY_SPEND)
    return t.events().select("event_id", spend.alias("spend"), total.alias("month_spend"), upkeep.limit_of(day, fixed.DAY_CALLS, fixed.DAILY_CALLS).alias("calls"))


@query(
    "free_calls",
    f""", c AS (SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') || '/' || (user_id % 50) AS day, event_type = 'error' AND value > 60 AS stop FROM ev),
    s AS (SELECT *, coalesce(bool_or(stop) OVER p, FALSE) AS blocked FROM c WINDOW p AS (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    u AS (SELECT *, least({fixed.FREE_CALLS}, coalesce(count(*) FILTER (WHERE NOT stop AND NOT blocked) OVER (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prior FROM s)
    SELECT event_id, CAST(prior + CASE WHEN NOT blocked AND prior < {fixed.FREE_CALLS} THEN 1 ELSE 0 END AS BIGINT) AS used, NOT blocked AND prior < {fixed.FREE_CALLS} AS allowed, CASE WHEN blocked THEN 'blocked' WHEN prior >= {fixed.FREE_CALLS} THEN 'daily-limit' ELSE '' END AS reason FROM u WHERE NOT stop""",
)
def _(t):
    stop = (F.col("event_type") == "error") & (F.col("value") > 60)
    calls = t.events().select("event_id", F.concat_ws("/", korea_day(F.col("ts")), F.col("user_id") % 50).alias("day"), F.col("event_id").alias("ordinal"), F.when(stop, "block").otherwise("call").alias("kind"))
    return upkeep.free_calls(calls).select("event_id", "used", "allowed", "reason")


_RUN = f""", run AS (SELECT sha256(CAST(ordinal * 3 AS VARCHAR)) AS url_key, ordinal, url, host, discovery, bucket, is_popular, CAST(published AS TIMESTAMP) AS published, 4 * (ordinal % 12) AS used,
      CASE WHEN ordinal % 41 = 0 THEN '' WHEN ordinal % 43 = 0 THEN '주요 뉴스' WHEN ordinal % 47 = 0 THEN 'so?????' ELSE 'T' || ordinal END AS title,
      CASE WHEN ordinal % 7 = 0 THEN '충북일보' ELSE 'press' END AS press, size % 600 AS body_length, ordinal % 10 <> 0 AS has_capacity, ordinal % 4 <> 1 AS valid, ordinal % 9 = 0 AS is_duplicate FROM candidates),
    known AS (SELECT run.*, a.summary_quality AS stored_quality, coalesce(t.attempts, 0) < 2 AS may_retry FROM run LEFT JOIN articles a USING (url_key) LEFT JOIN attempts t USING (url_key)),
    told AS (SELECT ordinal, bucket, CASE WHEN used + {fixed.PER_CANDIDATE} > {fixed.SUBREQUESTS} THEN 'subrequest_budget'
      WHEN title = '' OR title IN ({", ".join(f"'{x}'" for x in fixed.GENERIC_TITLES)}) OR {rejects_sql("title")} OR NOT regexp_matches(url, '^https?://') THEN 'invalid_metadata'
      WHEN NOT CASE WHEN discovery = 'KAKAO' THEN (host = 'v.daum.net' OR host LIKE '%.news.daum.net' OR host = 'news.daum.net') ELSE NOT ({" OR ".join(f"host LIKE '%{h}'" for h in fixed.BLOCKED_HOSTS + fixed.WRAPPER_HOSTS)}) END THEN 'disallowed_url'
      WHEN published < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'too_old' WHEN stored_quality = 'full' THEN 'existing_full'
      WHEN stored_quality IS NOT NULL THEN CASE WHEN NOT has_capacity THEN 'existing_repair_over_daily_limit' WHEN NOT may_retry THEN 'existing_repair_deferred' WHEN valid THEN 'existing_repaired' ELSE 'existing_repair_failed' END
      WHEN NOT has_capacity THEN 'daily_publish_limit' WHEN bucket <> 'baduk' AND NOT is_popular AND press = '충북일보' THEN 'local_general_filtered'
      WHEN body_length < {fixed.BODY_OK} THEN 'body_too_short' WHEN is_duplicate THEN 'inserted_duplicate' WHEN valid THEN 'inserted_publishable' ELSE 'inserted_pending_summary' END AS outcome FROM known)"""


def _run(t: Tables) -> DataFrame:
    i = F.col("ordinal")
    title = F.when(i % 41 == 0, "").when(i % 43 == 0, "주요 뉴스").when(i % 47 == 0, "so?????").otherwise(F.concat(F.lit("T"), i))
    rows = t.candidates().select(
        Tables.key(i * 3).alias("url_key"), "ordinal", "url", "discovery", "bucket", "is_popular", F.col("published").cast("timestamp").alias("published"), (4 * (i % 12)).alias("used"), title.alias("title"),
        F.when(i % 7 == 0, "충북일보").otherwise("press").alias("press"), (F.col("size") % 600).alias("body_length"), (i % 10 != 0).alias("has_capacity"), (i % 4 != 1).alias("valid"), (i % 9 == 0).alias("is_duplicate"),
    )
    return upkeep.with_stored(rows, t.articles(), t.attempts()).withColumn("may_retry", F.col("attempts") < 2)


@query("outcome_chain", _RUN + " SELECT ordinal, outcome FROM told")
def _(t):
    return C.labelled(_run(t), upkeep.outcome_rules(NOW), upkeep.OTHERWISE).select("ordinal", "outcome")


@query("outcome_chain_counts", _RUN + " SELECT bucket, outcome, count(*) AS n FROM told GROUP BY 1, 2")
def _(t):
    return C.outcomes(C.labelled(_run(t), upkeep.outcome_rules(NOW), upkeep.OTHERWISE))


@query(
    "clamped_counters",
    """, d AS (SELECT user_id % 10 AS key, event_id, CASE WHEN event_type = 'error' THEN -trunc(value) ELSE trunc(value) END AS delta FROM ev),
    s AS (SELECT key, delta, sum(delta) OVER (PARTITION BY key ORDER BY event_id) AS so_far FROM d)
    SELECT key, CAST(sum(delta) - least(0, min(so_far)) AS BIGINT) AS value FROM s GROUP BY 1""",
)
def _(t):
    e = t.events().select((F.col("user_id") % 10).alias("key"), F.col("event_id").alias("arrival"), F.when(F.col("event_type") == "error", -F.col("value").cast("long")).otherwise(F.col("value").cast("long")).alias("delta"))
    return merge.counters(e)
