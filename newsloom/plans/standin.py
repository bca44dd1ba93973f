"""News tables made of the test tables, as DataFrames and as SQL that says the same.

Articles are documents dated by evenly spaced events, their title the first line and their summary the first paragraph; saves, hides, likes, rankings, attempts and runs are events of one type
each; candidates are pages. NOW stands in for the present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
USER = "7"


class Tables:
    """The stand-in tables of one folder, each made when it is first asked for. The two row counts come from file footers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._counts: tuple[int, int] | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def counts(self) -> tuple[int, int]:
        if self._counts is None:
            self._counts = (max(1, self.read("documents").count()), max(1, self.read("events").count()))
        return self._counts

    def events(self, kind: str | None = None) -> DataFrame:
        e = self.read("events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
        return e.filter(F.col("event_type") == kind) if kind else e

    @staticmethod
    def key(c) -> F.Column:
        return F.sha2(c.cast("string").cast("binary"), 256)

    def articles(self) -> DataFrame:
        """Title and summary are cut out before the join, so that a query which reads no body moves none, and what it asks of them is asked first."""
        n, m = self.counts
        d = self.read("documents").select("doc_id", "source", "lang", "text", F.substring_index("text", "\n", 1).alias("title"), F.substring_index("text", "\n\n", 1).alias("summary"))
        rows = d.join(self.events().select("event_id", "ts"), F.col("doc_id") * (m // n) == F.col("event_id"))
        i, at = F.col("doc_id"), lambda c, f="yyyy-MM-dd HH:mm:ss": F.date_format(c, f)
        return rows.select(
            i.alias("id"), self.key(i).alias("url_key"), F.concat(F.lit("https://n"), i % 7, F.lit(".example.com/article/"), F.lpad((i % 500).cast("string"), 3, "0"), F.lit("/"), i).alias("url"),
            "title", F.col("source"), F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("press"), F.col("lang").alias("category"),
            F.when(i % 33 == 0, "").when(i % 50 == 0, at("ts", "yyyy-MM-dd")).otherwise(at("ts")).alias("published_at"), at(F.col("ts") + F.expr("interval 1 hour")).alias("fetched_at"),
            F.col("summary").alias("raw_summary"), F.col("text").alias("body_text"), "summary",
            F.when(i % 20 == 0, "none").when(i % 20 == 1, "duplicate").otherwise("full").alias("summary_quality"), F.when(i % 4 == 0, "").otherwise("https://img.example.com/x.jpg").alias("image_url"),
        )

    def marks(self, kind: str) -> DataFrame:
        n, _ = self.counts
        return self.events(kind).select(F.col("user_id").cast("string").alias("user_id"), self.key(F.col("event_id") % n).alias("url_key")).distinct()

    def saved(self) -> DataFrame:
        return self.marks("click")

    def hidden(self) -> DataFrame:
        return self.marks("error")

    def likes(self) -> DataFrame:
        return self.marks("view")

    def likes_at(self) -> DataFrame:
        n, _ = self.counts
        return self.events("view").groupBy(F.concat(F.lit("account:"), F.col("user_id").cast("string")).alias("user_id"), self.key(F.col("event_id") % n).alias("url_key")).agg(F.min("ts").alias("liked_at"))

    def popularity_log(self) -> DataFrame:
        n, _ = self.counts
        e = self.events("purchase")
        return e.select(self.key(F.col("event_id") % n).alias("url_key"), F.col("value").alias("score"), (1 + F.col("event_id") % 30).cast("int").alias("rank"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), F.col("event_id").alias("arrival"))

    def popularity(self) -> DataFrame:
        from ..operators.merge import popularity_live

        return popularity_live(self.popularity_log())

    def popular_items(self) -> DataFrame:
        from ..operators.merge import latest_per_key

        n, _ = self.counts
        e = self.events("signup").filter("value > 50").select((F.col("event_id") % n).alias("id"), F.col("value").alias("score"), (1 + F.col("event_id") % 30).cast("int").alias("rank"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), F.col("event_id").alias("arrival"))
        titled = e.join(self.articles().select("id", "title"), "id").drop("id")
        return latest_per_key(titled, ["title"], "arrival")

    def attempts(self) -> DataFrame:
        n, _ = self.counts
        return self.events("view").groupBy(self.key(F.col("event_id") % n).alias("url_key")).agg(F.count("*").alias("attempts"), F.max("ts").alias("last_attempt"))

    def checks(self) -> DataFrame:
        return self.read("labels").select(self.key(F.col("doc_id")).alias("url_key"))

    def runs(self) -> DataFrame:
        e = self.events("error")
        status = F.when(F.col("user_id") % 5 == 0, "error").when(F.col("user_id") % 5 == 1, "running").otherwise("ok")
        return e.select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), status.alias("status"), F.col("props").alias("message"))

    def candidates(self) -> DataFrame:
        p = self.read("pages")
        i = F.col("page_id")
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
        clean = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/$", "")
        return p.select(
            self.key(clean).alias("url_key"), "url", host.alias("host"), F.when(i % 3 == 0, "baduk").otherwise("general").alias("bucket"), (i % 4 == 0).alias("known"), (i % 5 == 0).alias("trusted"),
            (i % 6 == 0).alias("is_popular"), F.when(i % 6 == 0, (i % 30).cast("int")).alias("popularity_rank"), F.date_add(F.lit("2024-01-31").cast("date"), -(i % 45).cast("int")).alias("published"),
            F.when(i % 2 == 0, "KAKAO").otherwise("NAVER").alias("discovery"), F.length("html").alias("size"), i.alias("ordinal"),
        )


CTES = """
n AS (SELECT greatest(1, (SELECT count(*) FROM documents)) AS nd, greatest(1, (SELECT count(*) FROM events)) AS ne),
ev AS (SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, props FROM events),
articles AS (SELECT doc_id AS id, sha256(CAST(doc_id AS VARCHAR)) AS url_key,
    'https://n' || (doc_id % 7) || '.example.com/article/' || lpad(CAST(doc_id % 500 AS VARCHAR), 3, '0') || '/' || doc_id AS url,
    split_part(text, chr(10), 1) AS title, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS press, lang AS category,
    CASE WHEN doc_id % 33 = 0 THEN '' WHEN doc_id % 50 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_at,
    strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS fetched_at, split_part(text, chr(10) || chr(10), 1) AS raw_summary, text AS body_text, split_part(text, chr(10) || chr(10), 1) AS summary,
    CASE WHEN doc_id % 20 = 0 THEN 'none' WHEN doc_id % 20 = 1 THEN 'duplicate' ELSE 'full' END AS summary_quality,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://img.example.com/x.jpg' END AS image_url
    FROM documents JOIN ev ON event_id = doc_id * (SELECT ne // nd FROM n)),
timed AS (SELECT *, date_trunc('second', TRY_CAST(coalesce(nullif(published_at, ''), fetched_at) AS TIMESTAMP)) AS when_ts FROM articles),
marks AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id, sha256(CAST(event_id % (SELECT nd FROM n) AS VARCHAR)) AS url_key FROM ev),
saved AS (SELECT user_id, url_key FROM marks WHERE event_type = 'click'),
hidden AS (SELECT user_id, url_key FROM marks WHERE event_type = 'error'),
likes AS (SELECT user_id, url_key FROM marks WHERE event_type = 'view'),
popularity_log AS (SELECT sha256(CAST(event_id % (SELECT nd FROM n) AS VARCHAR)) AS url_key, value AS score, CAST(1 + event_id % 30 AS INTEGER) AS rank,
    's' || (user_id % 3) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at, event_id AS arrival FROM ev WHERE event_type = 'purchase'),
popularity AS (SELECT * FROM popularity_log QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY arrival DESC) = 1),
popular_items AS (SELECT a.title, e.value AS score, CAST(1 + event_id % 30 AS INTEGER) AS rank, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at, event_id AS arrival
    FROM ev e JOIN articles a ON a.id = e.event_id % (SELECT nd FROM n) WHERE event_type = 'signup' AND value > 50 QUALIFY row_number() OVER (PARTITION BY a.title ORDER BY event_id DESC) = 1),
attempts AS (SELECT sha256(CAST(event_id % (SELECT nd FROM n) AS VARCHAR)) AS url_key, count(*) AS attempts, max(ts) AS last_attempt FROM ev WHERE event_type = 'view' GROUP BY 1),
checks AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS url_key FROM labels),
runs AS (SELECT event_id AS id, ts AS started_at, CASE user_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'running' ELSE 'ok' END AS status, props AS message FROM ev WHERE event_type = 'error'),
candidates AS (SELECT sha256(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS url_key, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
    CASE WHEN page_id % 3 = 0 THEN 'baduk' ELSE 'general' END AS bucket, page_id % 4 = 0 AS known, page_id % 5 = 0 AS trusted, page_id % 6 = 0 AS is_popular,
    CASE WHEN page_id % 6 = 0 THEN CAST(page_id % 30 AS INTEGER) END AS popularity_rank, CAST(DATE '2024-01-31' - CAST(page_id % 45 AS INTEGER) AS DATE) AS published,
    CASE WHEN page_id % 2 = 0 THEN 'KAKAO' ELSE 'NAVER' END AS discovery, length(html) AS size, page_id AS ordinal FROM pages)"""


def sql(body: str) -> str:
    """body over the stand-in tables; it may go on with further tables ('x AS (...) SELECT ...') after a leading comma."""
    return "WITH" + CTES + body
