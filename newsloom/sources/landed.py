"""Sources as landed files: search answers, feeds, listings and rankings become rows of one candidate schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.extract import decoded
from ..functions.text import clean_title, normalize, rejected_title_c, vectorised

CANDIDATE = "title string, link string, originallink string, description string, pub_date string, press string, source string, ordinal long"

#: Search terms in turn; the order is part of the rotation.
QUERIES = (
    "바둑", "baduk", "바둑 대회", "바둑 행사", "바둑 축제", "전국 바둑대회", "한국기원 대회", "대한바둑협회 바둑대회", "아마 바둑대회",
    "아마추어 바둑대회", "어린이 바둑대회", "전국 어린이 바둑대회", "초등 바둑대회", "학생 바둑대회", "청소년 바둑대회", "유소년 바둑대회",
    "꿈나무 바둑대회", "학교 바둑대회", "지역 바둑대회", "시니어 아마 바둑대회", "생활체육 바둑대회", "바둑 참가자 모집", "바둑교실 대회",
    "바둑문화 행사", "시도 바둑협회 대회", "전국체전 바둑", "소년체전 바둑", "바둑 신진서", "프로바둑 대회", "바둑리그", "여자바둑리그",
    "시니어바둑리그", "바둑 기전", "세계 바둑대회", "신진서 대국", "최정 바둑",
)
SECTION_IDS = ("100", "101", "102", "103", "104")


def rotation(slot: int, n: int = 8) -> list[str]:
    """The queries of a half-hour slot."""
    return [QUERIES[(slot * n + i) % len(QUERIES)] for i in range(n)]


def search_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON answers {items: [{title, link, originallink, description, pubDate}]} of the news search."""
    items = "array<struct<title:string,link:string,originallink:string,description:string,pubDate:string>>"
    rows = spark.read.schema(f"items {items}").json(path, multiLine=True).select(F.posexplode("items").alias("pos", "i"))
    title = vectorised(clean_title)
    return rows.select(title("i.title").alias("title"), "i.link", "i.originallink", vectorised(normalize)("i.description").alias("description"), F.col("i.pubDate").alias("pub_date"), F.lit("").alias("press"), F.lit("NAVER").alias("source"), F.col("pos").cast("long").alias("ordinal"))


def web_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON answers {documents: [{title, url, contents, datetime}]} of the web search, under the same names."""
    items = "array<struct<title:string,url:string,contents:string,datetime:string>>"
    rows = spark.read.schema(f"documents {items}").json(path, multiLine=True).select(F.posexplode("documents").alias("pos", "i"))
    return rows.select(vectorised(clean_title)("i.title").alias("title"), F.col("i.url").alias("link"), F.col("i.url").alias("originallink"), vectorised(normalize)("i.contents").alias("description"), F.col("i.datetime").alias("pub_date"), F.lit("").alias("press"), F.lit("KAKAO").alias("source"), F.col("pos").cast("long").alias("ordinal"))


def _tag(block: Column, tag: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return vectorised(normalize)(F.regexp_replace(inner, r"^<!\[CDATA\[|\]\]>$", ""))


def rss_items(feeds: DataFrame, xml: str = "xml", most: int = 5) -> DataFrame:
    """The first items of each feed; the press is what follows the last ' - ' of the title."""
    blocks = F.slice(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1)), 1, most)
    rows = feeds.select(F.posexplode(blocks).alias("pos", "block"))
    rows = rows.select("pos", *[_tag(F.col("block"), t).alias(t) for t in ("title", "link", "description", "pubDate")])
    press = F.regexp_extract("title", r"(?s)^.+\s+-\s+(.*?)$", 1)
    title = F.when(F.col("title").rlike(r"(?s).\s+-\s+"), F.regexp_replace("title", r"(?s)^(.+)\s+-\s+.*?$", "$1")).otherwise(F.col("title"))
    return rows.select(title.alias("title"), "link", F.col("link").alias("originallink"), "description", F.col("pubDate").alias("pub_date"), press.alias("press"), F.lit("GOOGLE").alias("source"), F.col("pos").cast("long").alias("ordinal"))


def _anchors(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(pos, href, inner) of each link of a page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a[^>]+href=["'][^"']+["'][^>]*>.*?</a>"""), F.lit(0))
    rows = pages.select(*keep, F.posexplode(found).alias("pos", "a"))
    return rows.select(*keep, "pos", F.regexp_extract("a", r"""(?is)href=["']([^"']+)["']""", 1).alias("href"), F.regexp_extract("a", r"(?is)<a[^>]*>(.*?)</a>", 1).alias("inner"))


def _absolute(href: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(href)


HOST_RULES = {"NAVER": r"(?i)naver\.com/(?:main/ranking/(?:read|rankingRead)\.naver|mnews/article|article/)", "DAUM": r"(?i)(?:v\.daum\.net/v/|news\.daum\.net/)"}


def ranking(pages: DataFrame, source: str | None = None, most: int = 30, url: str = "url", html: str = "html") -> DataFrame:
    """(page, rank, href, title): links of ranking pages in order, one an address, titles of eight characters or more."""
    rows = _anchors(pages.withColumnRenamed(url, "page"), html, ["page"]).withColumn("href", _absolute(vectorised(normalize)("href"), F.col("page")))
    if source in HOST_RULES:
        rows = rows.filter(F.col("href").rlike(HOST_RULES[source]))
    rows = rows.withColumn("title", vectorised(clean_title)("inner")).filter((F.length("title") >= 8) & ~rejected_title_c(F.col("title")))
    rows = rows.groupBy("page", "href").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("pos")))
    return rows.filter(F.col("rank") <= most).select("page", "rank", "href", "title")


def listing(pages: DataFrame, base: str, most: int = 12, html: str = "html") -> DataFrame:
    """The association's own listing: title and date of each report; noon in Korea stands for the unknown time of day."""
    rows = _anchors(pages, html, []).filter(F.col("href").rlike(r"(?i)report_view\.asp\?[^\"']*news_no=[0-9]+"))
    link = F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), F.replace("href", F.lit("&amp;"), F.lit("&")))
    title = vectorised(clean_title)(F.regexp_extract("inner", r"(?is)<dt[^>]*>(.*?)</dt>", 1))
    date = vectorised(normalize)(F.regexp_extract("inner", r"""(?is)<span[^>]+class=["']date["'][^>]*>(.*?)</span>""", 1))
    rows = rows.select("pos", link.alias("link"), title.alias("title"), date.alias("date")).filter((F.length("title") >= 8) & ~rejected_title_c(F.col("title")))
    rows = rows.groupBy("link").agg(F.min_by("title", "pos").alias("title"), F.min_by("date", "pos").alias("date"), F.min("pos").alias("pos"))
    at = F.when(F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat("date", F.lit(" 12:00:00"))).otherwise("")
    return rows.orderBy("pos").limit(most).select("title", "link", at.alias("pub_date"), F.lit("한국기원").alias("press"))


def popularity(pages: DataFrame, slot: int = 0, each: int = 4) -> DataFrame:
    """Rows (section, rank, href, title) of ranking pages (section: place in the list of pages): the first of each section, then the
    second of each; sections start at the slot's, the last page stays last."""
    n = len(SECTION_IDS)
    turn = F.when(F.col("section") >= n, F.col("section")).otherwise(F.pmod(F.col("section") - slot % n, F.lit(n)))
    top = pages.filter(F.col("rank") <= each).withColumn("turn", turn)
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy("rank", "turn")))


def archive_days(spark: SparkSession, today: str, slot: int, days: int = 3) -> DataFrame:
    """(day, section, score): the days of the past that a slot looks at, for each section."""
    offset = (slot % 10) * days
    rows = spark.range(days).select("id", F.explode(F.array(*map(F.lit, SECTION_IDS))).alias("section"))
    return rows.select(F.date_format(F.date_sub(F.lit(today).cast("date"), (F.lit(offset) + F.col("id")).cast("int")), "yyyyMMdd").alias("day"), "section", (70 - offset - F.col("id")).alias("score"))


def backfill_day_ok(ymd: str, today: str) -> bool:
    """A date to fill in: eight digits, not ahead, at most 31 days back."""
    from datetime import datetime

    try:
        back = (datetime.strptime(today, "%Y-%m-%d") - datetime.strptime(ymd, "%Y%m%d")).days
    except ValueError:
        return False
    return len(ymd) == 8 and 0 <= back <= 31


def discovered(rows: DataFrame, each: int = 5, most: int = 40) -> DataFrame:
    """Offline discovery: one row a title, so many a query, so many in all, in order of query and place."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("title").orderBy("query_no", "pos"))).filter("_n = 1").drop("_n")
    some = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_no").orderBy("pos"))).filter(F.col("_n") <= each).drop("_n")
    return some.orderBy("query_no", "pos").limit(most)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as binary files (path, content), decoded; EUC-KR is told by what UTF-8 makes of it."""
    read = F.pandas_udf(lambda s: s.map(decoded), "string")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), read("content").alias("html"))
