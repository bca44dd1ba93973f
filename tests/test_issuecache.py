"""Issues out of the cache as it was at a time."""

import json

from pyspark.sql import functions as F

from newsloom.operators import issuecache

HISTORY = "category string, id long, payload string, built_at timestamp"
CARDS = "ord int, url_key string, category string, title string, summary string, related_count int, moment string, score double"


def group(key, title, *keys, **more):
    return {"key": key, "title": title, "url_keys": list(keys)} | more


def history(spark, *rows):
    told = [(c, i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), at) for c, i, p, at in rows]
    return spark.createDataFrame(told, "category string, id long, payload string, at string").select("category", "id", "payload", F.to_timestamp("at").alias("built_at"))


def test_the_newest_by_then(spark):
    h = history(spark, ("a", 1, "[1]", "2024-01-01"), ("a", 2, "[2]", "2024-01-02"), ("a", 3, "[3]", "2024-01-02"), ("b", 4, "[4]", "2024-01-01"))
    asked = spark.createDataFrame([("a", "2023-12-31"), ("a", "2024-01-01"), ("a", "2024-01-01 23:00"), ("a", "2024-02-01"), ("b", "2024-02-01"), ("c", "2024-02-01")], "category string, at string")
    got = issuecache.as_of(h, asked.select("category", F.to_timestamp("at").alias("at"))).collect()
    assert sorted((r.category, str(r.at)[:16], r.payload) for r in got) == [("a", "2024-01-01 00:00", "[1]"), ("a", "2024-01-01 23:00", "[1]"), ("a", "2024-02-01 00:00", "[3]"), ("b", "2024-02-01 00:00", "[4]")]


def test_tiles_of_a_page(spark):
    cards = [
        (1, "k1", "바둑", "농심배 결승 1국", "신진서 승리", 0, "2024-01-03 10:00:00", 5.0), (2, "k2", "바둑", "농심배 2국", "", 2, "2024-01-04 10:00:00", 1.0),
        (3, "k3", "바둑", "이야기 하나", "", 0, "2024-01-05 10:00:00", 9.0), (4, "k4", "바둑", "이야기 둘", "", 1, "2024-01-02 10:00:00", 0.0),
    ]
    page = spark.createDataFrame(cards, CARDS)
    old = [group("바둑|ai:0", "옛 이슈 제목", "k4")]
    new = [
        group("바둑|ai:1", "농심배 결승", "k1", "gone"), group("바둑|ai:2", "기원 소식", "k4", main_key="k4", odd=[1]), group("바둑|ai:3", "농심배 대국", "k2", "k1"),
        group("바둑|ai:misc", "기타", "k3", misc=True), {"key": "바둑|ai:4", "title": "빈 이슈", "url_keys": None},
    ]
    h = history(spark, ("바둑", 1, old, "2024-01-05"), ("바둑", 2, new, "2024-01-06"), ("바둑", 3, "{}", "2024-01-07"), ("바둑", 4, "[broken", "2024-01-08"))
    at = lambda t, cap=9: [(r.key, r.title, r["count"], r.latest, r.score) for r in issuecache.page_issues(page, h, "바둑", t, cap).orderBy("shown").collect()]
    assert at("2024-01-05 12:00:00") == [("바둑|ai:0", "옛 이슈 제목", 2, "2024-01-02 10:00:00", 0.0)]
    joined = ("바둑|ai:1", "농심배 결승", 4, "2024-01-04 10:00:00", 5.0)
    rest = ("바둑|ai:misc", "기타", 1, "2024-01-05 10:00:00", 9.0)
    assert at("2024-01-06 00:00:00") == [joined, ("바둑|ai:2", "기원 소식", 2, "2024-01-02 10:00:00", 0.0), rest]
    assert at("2024-01-06 00:00:00", 1) == [joined, rest]
    assert at("2024-01-04 00:00:00") == at("2024-01-07 00:00:00") == at("2024-01-08 00:00:00") == []
