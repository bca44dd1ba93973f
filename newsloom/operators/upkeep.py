"""Upkeep of stored state: ledgers, accounts, free calls, limits of single days, repairs by batch, and what became of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.extract import allowed_c
from ..functions.text import rejected_title_c
from ..functions.times import effective_time, is_date_only
from .merge import delete_keys

# --- state and ledgers ----------------------------------------------------------------------------------


def ledger_kept(state: DataFrame, today: str, days: int = 7, prefix: str = fixed.READ_LEDGER) -> DataFrame:
    """state (key, value) without the days of the ledger that lie more than so many days before today; other keys stay."""
    oldest = F.concat(F.lit(prefix), F.date_format(F.date_sub(F.to_date(F.lit(today)), days), "yyyy-MM-dd"))
    return state.filter(~(F.col("key").startswith(prefix) & (F.col("key") < oldest)))


def state_values(state: DataFrame, keys: list[str]) -> DataFrame:
    """One row: a column for each of the keys, null for one that is not stored."""
    return state.filter(F.col("key").isin(keys)).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def newest_by_cutoff(rows: DataFrame, n: int, by: str = "id") -> DataFrame:
    """rows without those up to the first one beyond the n newest. Only that one value is looked up, so no row is sorted twice."""
    cut = rows.select(by).orderBy(F.desc(by)).offset(n).limit(1).agg(F.max(by).alias("cut")).withColumn("one", F.lit(1))
    out = rows.withColumn("one", F.lit(1)).join(cut, "one").filter(F.col("cut").isNull() | (F.col(by) > F.col("cut")))
    return out.select(*rows.columns)


def recent_diagnostics(runs: DataFrame, now: str, hours: int = 24, most: int = 30) -> DataFrame:
    """(name, runs, total): counters of the messages of the newest runs, summed; one inside another object is named outer.inner."""
    recent = runs.filter(F.col("started_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")).orderBy(F.desc("id")).limit(most)
    outer = recent.select(F.explode(F.from_json("message", "map<string,string>")).alias("name", "text"))
    inner = F.from_json(F.when(F.col("text").startswith("{"), F.col("text")), "map<string,double>")
    whole = F.create_map(F.lit(""), F.col("text").try_cast("double"))
    counts = outer.select("name", F.explode(F.coalesce(inner, whole)).alias("part", "n")).filter("n is not null")
    named = F.when(F.col("part") == "", F.col("name")).otherwise(F.concat_ws(".", "name", "part"))
    return counts.groupBy(named.alias("name")).agg(F.count("*").alias("runs"), F.sum("n").cast("long").alias("total"))


# --- times ----------------------------------------------------------------------------------------------


def noon_downgraded(published: Column, day: str) -> Column:
    """The invented noon of a day becomes the day alone."""
    return F.when(published == f"{day}T12:00:00.000Z", F.substring(published, 1, 10)).otherwise(published)


def time_repair_batch(articles: DataFrame, checks: DataFrame, now: str, cursor: int, most: int) -> DataFrame:
    """The next articles whose time is to be read again, in order of id: published ones after the cursor without a time of day that were not
    looked at yet, and all that lie ahead of now. Each side is cut before they meet."""
    t = F.to_timestamp(F.lit(now))
    recent = articles.filter(effective_time(F.col("published_at"), F.col("fetched_at")) >= t - F.expr("interval 30 days"))
    timeless = (F.trim("published_at") == "") | is_date_only(F.col("published_at"))
    open_ = recent.filter((F.col("id") > cursor) & (F.col("summary_quality") == "full") & ~F.col("url").contains(fixed.TIMELESS_HOST) & timeless).join(checks, "url_key", "left_anti")
    ahead = recent.filter(F.col("published_at").try_cast("timestamp") > t + F.expr("interval 2 hours"))
    some = [x.select("id", "url_key", "url", "published_at").orderBy("id").limit(most) for x in (open_, ahead)]
    return some[0].union(some[1]).dropDuplicates(["id"]).orderBy("id").limit(most)


# --- accounts -------------------------------------------------------------------------------------------


def valid_username(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"\A[a-z0-9._-]{3,32}\z")


def valid_password(password: Column) -> Column:
    return F.length(F.coalesce(password, F.lit(""))).between(4, 64)


def tombstone(users: DataFrame, username: str, now: str) -> DataFrame:
    """users (username, password_hash, role, active, updated_at) with one who can no longer sign in, also if the name was not stored."""
    gone = users.sparkSession.range(1).select(F.lit(username).alias("username"), F.lit("").alias("password_hash"), F.lit("member").alias("role"), F.lit(0).alias("active"), F.lit(now).alias("updated_at"))
    role = users.filter(F.col("username") == username).select("username", F.col("role").alias("old_role"))
    gone = gone.join(role, "username", "left").withColumn("role", F.coalesce("old_role", "role"))
    return users.filter(F.col("username") != username).unionByName(gone.select(*users.columns))


def account_deleted(saved: DataFrame, hidden: DataFrame, users: DataFrame, username: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(saved, hidden, users) after an account is deleted. Write all in one step."""
    others = F.col("user_id") != f"account:{username}"
    return saved.filter(others), hidden.filter(others), tombstone(users, username, now)


# --- budgets --------------------------------------------------------------------------------------------


def limit_of(period: Column, exceptions: dict[str, int], usual: int) -> Column:
    """The limit of a day or month: that of the table of exceptions, else the usual one."""
    if not exceptions:
        return F.lit(usual)
    table = F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair])
    return F.coalesce(F.try_element_at(table, period), F.lit(usual))


def free_calls(calls: DataFrame, most: int = fixed.FREE_CALLS) -> DataFrame:
    """calls (day, ordinal, kind 'call' or 'block') that are calls, with used (free calls of the day, this one included if it is one),
    allowed and reason: a block ends the day's free calls, else their number does."""
    before = Window.partitionBy("day").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    is_call = F.col("kind") == "call"
    rows = calls.withColumn("blocked", F.coalesce(F.max(F.col("kind") == "block").over(before), F.lit(False)))
    rows = rows.withColumn("prior", F.least(F.lit(most).cast("long"), F.coalesce(F.count_if(is_call & ~F.col("blocked")).over(before), F.lit(0).cast("long"))))
    allowed = ~F.col("blocked") & (F.col("prior") < most)
    reason = F.when(F.col("blocked"), "blocked").when(F.col("prior") >= most, "daily-limit").otherwise("")
    return rows.filter(is_call).withColumns({"used": F.col("prior") + allowed.cast("long"), "allowed": allowed, "reason": reason}).drop("blocked", "prior")


# --- candidates -----------------------------------------------------------------------------------------


def with_stored(candidates: DataFrame, articles: DataFrame, attempts: DataFrame) -> DataFrame:
    """candidates with stored_quality (null: not stored yet) and attempts of the article that has their key: two joins for a whole run."""
    stored = articles.select("url_key", F.col("summary_quality").alias("stored_quality"))
    return candidates.join(stored, "url_key", "left").join(attempts.select("url_key", "attempts"), "url_key", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))


def outcome_rules(now: str) -> list[tuple[Column, str]]:
    """What becomes of a candidate; the first rule that holds decides. Columns: used (sub-requests of the run so far), url, title,
    discovery, published (timestamp), stored_quality, has_capacity, may_retry, valid (its summary passes), bucket, is_popular, press,
    body_length, is_duplicate."""
    c = F.col
    title = F.coalesce("title", F.lit(""))
    stored = c("stored_quality").isNotNull()
    valid = F.coalesce("valid", F.lit(False))
    return [
        (c("used") + fixed.PER_CANDIDATE > fixed.SUBREQUESTS, "subrequest_budget"),
        ((title == "") | title.isin(*fixed.GENERIC_TITLES) | rejected_title_c(title) | ~F.coalesce("url", F.lit("")).rlike("^https?://"), "invalid_metadata"),
        (~allowed_c(c("url"), c("discovery")), "disallowed_url"),
        (c("published") < F.to_timestamp(F.lit(now)) - F.expr("interval 30 days"), "too_old"),
        (c("stored_quality") == "full", "existing_full"),
        (stored & ~c("has_capacity"), "existing_repair_over_daily_limit"),
        (stored & ~c("may_retry"), "existing_repair_deferred"),
        (stored & valid, "existing_repaired"),
        (stored, "existing_repair_failed"),
        (~c("has_capacity"), "daily_publish_limit"),
        ((c("bucket") != "baduk") & ~c("is_popular") & c("press").rlike(fixed.LOCAL_PRESS), "local_general_filtered"),
        (c("body_length") < fixed.BODY_OK, "body_too_short"),
        (c("is_duplicate"), "inserted_duplicate"),
        (valid, "inserted_publishable"),
    ]


#: What a candidate becomes to which no rule applies.
OTHERWISE = "inserted_pending_summary"


def account_moved(saved: DataFrame, hidden: DataFrame, users: DataFrame, old: str, new: str, password_hash: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(saved, hidden, users) after an account takes another name: marks go over unless the new one has them, the old name stays as a
    tombstone."""
    a, b = f"account:{old}", f"account:{new}"

    def moved(marks: DataFrame) -> DataFrame:
        theirs = marks.filter(F.col("user_id") == a).withColumn("user_id", F.lit(b))
        rest = marks.filter(F.col("user_id") != a)
        return rest.unionByName(delete_keys(theirs, rest, ["user_id", "url_key"]))

    made = users.sparkSession.range(1).select(F.lit(new).alias("username"), F.lit(password_hash).alias("password_hash"), F.lit("member").alias("role"), F.lit(1).alias("active"), F.lit(now).alias("updated_at"))
    return moved(saved), moved(hidden), tombstone(users, old, now).unionByName(made.select(*users.columns))
