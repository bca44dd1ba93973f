"""Operators on small tables: merges, state, folds, issues, sources and streams."""

import json
from datetime import datetime, timedelta

import pandas as pd
from newsloom.operators import candidates, control, issues, merge, reports, stories
from newsloom.operators.feed import FeedParams, pool_size
from newsloom.plans.standin import Tables
from newsloom.providers import Rules
from newsloom.sources import landed
from newsloom.streaming import jobs
from pyspark.sql import functions as F


def test_feed_params():
    p = FeedParams(now="2024-01-01", limit=0, hours=9999, view="x", query=" a ").clamped()
    assert (p.limit, p.hours, p.view, p.query) == (60, 720, "latest", "a")
    assert FeedParams(now="", limit=999).clamped().limit == 300
    assert (pool_size(60, "latest"), pool_size(60, "home"), pool_size(10, "latest", True, True), pool_size(300, "latest", True)) == (60, 150, 120, 150)


def test_upsert_keeps_the_longer(spark):
    s = "id long, url_key string, title string, press string, category string, published_at string, raw_summary string, summary_quality string, body_text string, summary string, url string"
    old = spark.createDataFrame([(1, "a", "t", "p", "c", "d", "r", "full", "long body", "s", "u")], s)
    new = spark.createDataFrame([(9, "a", "T", "P", "C", "D", "R", "none", "short", "longer", "U"), (2, "b", "t2", "p", "c", "d", "r", "full", "b", "s", "u2")], s)
    got = {r.url_key: r for r in merge.upsert_articles(old, new).collect()}
    assert (got["a"].id, got["a"].title, got["a"].body_text, got["a"].summary, got["a"].summary_quality, got["a"].url) == (1, "T", "long body", "longer", "none", "u")
    assert got["b"].id == 2


def test_counters_never_fall_below_zero(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, -9), ("a", 3, 2), ("b", 1, -1)], "key string, arrival long, delta long")
    assert {r.key: r.value for r in merge.counters(rows).collect()} == {"a": 2, "b": 0}
    assert control.settle([("reserve", 5), ("settle", -9), ("reserve", 2)]) == 2


def test_cache_and_rollback(spark):
    cache = spark.createDataFrame([("x", "[1]", "t1")], "category string, payload string, built_at string")
    history = spark.createDataFrame([], "id long, category string, payload string, built_at string, backed_up_at string")
    cache, history = merge.cache_put(cache, history, "x", "[2]", "t2")
    assert cache.collect()[0].payload == "[2]" and history.collect()[0].payload == "[1]"
    cache, history = merge.cache_rollback(cache, history, "x", "t3")
    assert cache.collect()[0].payload == "[1]" and history.count() == 2
    assert merge.cache_rollback(cache, history, "y", "t4")[0] is cache


def test_call_limits():
    limit = control.call_limit
    assert (limit(10, "general"), limit(10, "baduk"), limit(21, "general"), limit(10, "general", boost=True), limit(10, "general", recovery=True)) == (24, 60, 60, 48, 90)


def test_host_ledger():
    ledger = control.HostLedger()
    for i in range(5):
        ledger.record("a.com", False, "http_503", i)
        ledger.record("b.com", False, "http_404", i)
        ledger.record("v.daum.net", False, "http_503", i)
    assert ledger.closed("a.com", 100) and not ledger.closed("b.com", 100) and not ledger.closed("v.daum.net", 100)
    assert not ledger.closed("a.com", 4 + 24 * 3600)
    assert control.HostLedger(ledger.stored(100)).closed("a.com", 100)
    assert "a.com" not in control.HostLedger(ledger.stored(49 * 3600)).hosts
    assert control.HostLedger('{"__rule": "1", "a.com": {"fail": 9, "at": 0}}').hosts == {} and control.HostLedger("junk").hosts == {}
    ledger.record("a.com", True, "ok", 200)
    assert not ledger.closed("a.com", 201)


def test_bounded_json():
    s = control.bounded_json({"a": "x" * 100, "b": 1}, 30)
    assert json.loads(s) == {"b": 1}


def test_observed_rows(spark):
    rows, seen = control.metered(spark.range(10))
    rows.collect()
    assert seen.get["rows_read"] == 10 and not control.fuse_blown(10)


def test_stall():
    run = {"reachable": True, "status": 200, "last_run": {"status": "ok"}, "last_automatic_run": {"started_ms": 0}}
    assert reports.stalled(run, 5 * 3_600_000) and not reports.stalled(run, 3_600_000) and reports.stalled({"reachable": False}, 0)
    assert not reports.stalled(run | {"last_run": {"status": "running"}}, 10**9)


def test_dice_pairs_are_exact(spark, data):
    from newsloom.functions.similarity import bigrams, dice

    rows = [(r.id, "".join(c for c in r.title.lower() if c.isascii() and c.isalnum())) for r in Tables(spark, data).articles().select("id", "title").collect()]
    wanted = {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if i < j and dice(bigrams(a), bigrams(b)) >= 0.7}
    got = {(r.left, r.right) for r in stories.dice_pairs(Tables(spark, data).articles(), 0.7).collect()}
    assert got == wanted


def test_story_index():
    index = stories.StoryIndex(["태풍 돌핀 북상 제주 비상"])
    assert index.match("태풍 돌핀 북상…제주 비상") == "태풍 돌핀 북상 제주 비상" and index.match("다른 이야기") == "" and index.match("") == ""
    index.add("기원에서 말다툼하다 흉기 휘둘러 지인 살해 60대 체포")
    assert index.match("기원서 바둑 두다 말다툼 지인 살해한 60대 현행범 체포", baduk=False) and not index.match("기원서 바둑 두다 말다툼 지인 살해한 60대 현행범 체포")


def row(i, title, **more):
    return {"id": i, "url": f"https://x.com/{i}", "url_key": f"k{i}", "title": title, "source": "s", "press": "p", "category": "사회", "published_at": "", "summary": f"1) {title} 요약", "summary_quality": "full", "popularity_score": 0.0} | more


def test_cards():
    rows = [row(1, "태풍 돌핀 북상 제주 비상"), row(2, "태풍 돌핀 북상…제주 비상"), row(3, "전혀 다른 경제 소식 하나"), row(4, "붙을 곳 없는 중복 기사", summary_quality="duplicate")]
    cards = stories.fold_cards(rows, [])
    assert [c.row["id"] for c in cards] == [1, 3] and len(cards[0].related) == 0  # the same title is not related
    rows[1]["title"] = "태풍 돌핀 북상…제주 비상 걸려"
    assert [x["url_key"] for x in stories.fold_cards(rows, [])[0].related] == ["k2"]


def test_cards_of_an_issue_change_face():
    rows = [row(1, "태풍 소식 제주 공항 결항"), row(2, "태풍 소식 제주 공항 결항 속출"), row(3, "기타 묶음 기사")]
    group = {"key": "일반|ai:0", "title": "태풍", "url_keys": ["k1", "k2"], "main_key": "k2"}
    card = stories.fold_cards(rows, [group])[0]
    assert card.row["id"] == 2 and [x["url_key"] for x in card.related] == ["k1"]
    misc = {"key": "일반|ai:misc", "title": "기타", "url_keys": ["k1", "k3"]}
    assert len(stories.fold_cards(rows, [misc])) == 2


def test_issue_rules():
    arts = [{"url_key": k, "title": t, "summary": "", "category": "바둑"} for k, t in (("a", "제3회 부라보콘 어린이 바둑대회 개최"), ("b", "일반 소식"), ("c", "수협은행 최강전"))]
    groups = [{"key": "바둑|ai:0", "title": "부라보콘", "url_keys": ["a", "zz"]}, {"key": "바둑|ai:1", "title": "기타", "url_keys": ["b"]}]
    out = issues.enforce(groups, arts, "바둑")
    assert [g["url_keys"] for g in out] == [["a"], ["b", "c"]] and out[-1]["misc"]
    assert issues.standalone_event(arts[0]) and not issues.standalone_event(arts[1])
    assert [g["title"] for g in issues.merge_titles([{"key": "x|ai:0", "title": "Sh수협은행 여자바둑최강전", "url_keys": ["a"]}, {"key": "x|ai:1", "title": "SH수협은행 여자바둑대회", "url_keys": ["b"]}])] == ["Sh수협은행 여자바둑최강전"]
    assert issues.legal_conflict("정치자금법 위반", "허위사실공표 혐의") and issues.location_conflict("일본 화재 사고", "서울 화재 사고")
    assert issues.topic_mismatch("삼성전자 실적", "날씨 소식") and not issues.topic_mismatch("삼성전자 실적", "삼성전자 소식")
    assert issues.json_array("말 ```json\n[1]``` 끝") == [1] and issues.json_array("none") is None


def test_model_answer_and_default_provider():
    arts = [{"url_key": f"k{i}", "title": t, "summary": "", "category": "사회"} for i, t in enumerate(["태풍 돌핀 북상 제주 비상", "태풍 돌핀 북상…제주 비상", "홀로 있는 소식"])]
    groups = issues.groups_of(json.dumps([{"title": "태풍", "indices": [0, 1, 1, 99], "main": 1}, {"title": "혼자", "indices": [2]}]), arts, set())
    assert groups[0]["url_keys"] == ["k0", "k1"] and groups[0]["main_key"] == "k1" and groups[1]["misc"]
    cache, _ = issues.classify(arts, [], "일반", Rules().group)
    assert [g["url_keys"] for g in cache] == [["k0", "k1"], ["k2"]] and cache[0]["key"] == "일반|ai:0"
    assert issues.classify(arts, cache, "일반", lambda a, c: "nothing")[0] is cache
    misc = issues.groups_of(json.dumps([{"title": "기타리스트 공연", "indices": [0, 1]}, {"title": "그 밖의 소식", "indices": [2]}]), arts, {"그 밖의 소식"})
    assert [(g["title"], bool(g.get("misc"))) for g in misc] == [("기타리스트 공연", False), ("기타", True)]
    assert issues.rule_key("신진서 최정 대결", "바둑") == "바둑|신진서|최정" and issues.rule_key("x", "사회") == ""


def test_cached_issues_of_a_page(spark):
    cards = [(1, "a", "사회", "정치자금법 위반 재판", "", 0), (2, "b", "사회", "허위사실공표 혐의", "", 0), (3, "c", "바둑", "제3회 부라보콘 어린이 바둑대회 개최", "", 0), (4, "d", "바둑", "일반 소식", "", 1), (5, "e", "바둑", "한 소식", "", 0)]
    cards = spark.createDataFrame(cards, "ord int, url_key string, category string, title string, summary string, related_count int")
    cache = [(0, "일반|ai:0", "정치자금법 재판", ["a", "b", "gone"]), (1, "바둑|ai:1", "소식", ["d"]), (2, "바둑|ai:2", "단신", ["e"]), (3, "바둑|ai:misc", "기타", ["c"])]
    cache = spark.createDataFrame(cache, "ord int, key string, title string, url_keys array<string>")
    got = [(r.key, r.url_keys) for r in issues.normalized(cards, cache).orderBy("ord").collect()]
    assert got == [("일반|ai:0", ["a"]), ("바둑|ai:1", ["d"]), ("바둑|ai:event:c", ["c"]), ("일반|ai:misc", ["b", "e"])]


def test_issues_without_a_cache(spark):
    cards = [(1, "신진서 최정 대결", "", "바둑", 2, "2026-01-02"), (2, "최정 신진서 또 대결", "", "바둑", 0, "2026-01-09"), (3, "x", "", "사회", 0, "2026-01-08")]
    cards = spark.createDataFrame(cards, "ord int, title string, summary string, category string, related_count int, at string")
    assert [tuple(r) for r in issues.fallback_issues(cards).collect()] == [(1, "바둑|신진서|최정", "신진서 · 최정", 4, "2026-01-02")]


def test_tiles_reserve_tournaments(spark):
    rows = [(f"x|ai:{i}", f"일반 {i}", 100 - i, "2024", 0.0) for i in range(6)] + [(f"x|ai:t{i}", f"대회 {i}", 1, "2024", 0.0) for i in range(3)] + [("x|ai:misc", "기타", 999, "2024", 0.0)]
    counts = spark.createDataFrame(rows, "key string, title string, count long, latest string, score double")
    shown = [r.title for r in issues.tiles(counts, 4).orderBy("shown").collect()]
    assert shown[-1] == "기타" and len(shown) == 5 and sum(t.startswith("대회") for t in shown) == 2


def test_sources(spark):
    html = "<a href='/mnews/article/001/1'>충분히 긴 기사 제목 하나</a><a href=\"//n.news.naver.com/article/2\">또 다른 긴 기사 제목 둘</a><a href='/mnews/article/001/1'>같은 주소의 다른 제목</a><a href='/x'>짧다</a>"
    pages = spark.createDataFrame([("https://n.news.naver.com/rank", html)], "url string, html string")
    got = landed.ranking(pages, "NAVER").orderBy("rank").collect()
    assert [(r.rank, r.href) for r in got] == [(1, "https://n.news.naver.com/mnews/article/001/1"), (2, "https://n.news.naver.com/article/2")]
    xml = "<rss><item><title><![CDATA[큰 제목 - 작은 말 - 신문]]></title><link>https://a/1</link><pubDate>d</pubDate></item><item><title>제목만</title></item></rss>"
    items = landed.rss_items(spark.createDataFrame([(xml,)], "xml string")).orderBy("ordinal").collect()
    assert [(r.title, r.press) for r in items] == [("큰 제목 - 작은 말", "신문"), ("제목만", "")]
    block = "<a href='report_view.asp?news_no=1&amp;x=2'><dt>협회가 낸 긴 보도 제목</dt><span class='date'>2026-08-14</span></a>"
    r = landed.listing(spark.createDataFrame([(block,)], "html string"), "https://b.or.kr/news/list.asp").first()
    assert (r.link, r.pub_date) == ("https://b.or.kr/news/report_view.asp?news_no=1&x=2", "2026-08-14 12:00:00")
    assert landed.rotation(0)[0] == "바둑" and len(landed.rotation(5)) == 8 and landed.backfill_day_ok("20260801", "2026-08-14") and not landed.backfill_day_ok("20260601", "2026-08-14")
    days = landed.archive_days(spark, "2024-01-31", 1).collect()
    assert len(days) == 15 and min(r.score for r in days) == 65


def test_landed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"title": "<b>제목</b>", "link": "l", "originallink": "o", "description": "d", "pubDate": "p"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"documents": [{"title": "t", "url": "u", "contents": "c", "datetime": "d"}]}))
    both = landed.search_answers(spark, str(tmp_path / "a.json")).unionByName(landed.web_answers(spark, str(tmp_path / "b.json")))
    assert sorted((r.title, r.source) for r in both.collect()) == [("t", "KAKAO"), ("제목", "NAVER")]


def test_candidates(spark):
    rows = [("a", "baduk", 1), ("a", "baduk", 2), ("b", "general", 3)]
    df = spark.createDataFrame(rows, "url_key string, bucket string, ordinal long")
    assert sorted(r.ordinal for r in candidates.unique(df).collect()) == [1, 3]
    labelled = candidates.labelled(df, [(F.col("ordinal") == 1, "x"), (F.col("url_key") == "a", "y")], "z")
    assert [r.outcome for r in labelled.orderBy("ordinal").collect()] == ["x", "y", "z"]


def test_stream_equals_batch(spark, data, tmp_path):
    events = Tables(spark, data).events()
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), events.schema)
    totals = jobs.run_to_end(jobs.daily_totals(stream), "totals", str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, control.tumbling_days(events).collect()))
    keyed = stream.withColumn("url_key", (F.col("event_id") % 50).cast("string"))
    once = jobs.run_to_end(jobs.seen_once(keyed), "once", str(tmp_path / "c2"))
    assert once.count() == 50


def test_stream_of_hosts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=i), i, False, "http_503") for i in range(7)] + [("b", start, 100, True, "ok")]
    df = spark.createDataFrame(rows, "host string, ts timestamp, id long, ok boolean, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_to_end(jobs.host_health(stream), "hosts", str(tmp_path / "c"), "append").orderBy("id").toPandas()
    want = control.quarantine(df.withColumnRenamed("ts", "at")).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want)
    assert got.skipped.tolist() == [False] * 5 + [True] * 2 + [False]


def test_outcome_rules_in_order(spark):
    from newsloom.operators import candidates, upkeep

    base = {"used": 0, "url": "https://a.example.com/1", "title": "t", "discovery": "NAVER", "published": "2024-01-30 00:00:00", "stored_quality": None, "has_capacity": True, "may_retry": True, "valid": True, "bucket": "general", "is_popular": False, "press": "p", "body_length": 500, "is_duplicate": False}
    cases = [
        ({}, "inserted_publishable"), ({"valid": None}, "inserted_pending_summary"), ({"is_duplicate": True}, "inserted_duplicate"), ({"body_length": 179}, "body_too_short"),
        ({"press": "충북일보"}, "local_general_filtered"), ({"press": "충북일보", "is_popular": True}, "inserted_publishable"), ({"press": "충북일보", "bucket": "baduk"}, "inserted_publishable"),
        ({"has_capacity": False}, "daily_publish_limit"), ({"has_capacity": False, "stored_quality": "none"}, "existing_repair_over_daily_limit"), ({"stored_quality": "full", "has_capacity": False}, "existing_full"),
        ({"stored_quality": "none", "may_retry": False}, "existing_repair_deferred"), ({"stored_quality": "none"}, "existing_repaired"), ({"stored_quality": "none", "valid": False}, "existing_repair_failed"),
        ({"published": "2023-12-01 00:00:00", "stored_quality": "full"}, "too_old"), ({"published": None}, "inserted_publishable"), ({"discovery": "KAKAO"}, "disallowed_url"),
        ({"title": "주요 뉴스", "discovery": "KAKAO"}, "invalid_metadata"), ({"title": None}, "invalid_metadata"), ({"used": 41, "title": ""}, "subrequest_budget"), ({"used": 40}, "inserted_publishable"),
    ]
    kinds = "used int, url string, title string, discovery string, published string, stored_quality string, has_capacity boolean, may_retry boolean, valid boolean, bucket string, is_popular boolean, press string, body_length int, is_duplicate boolean, wanted string"
    rows = spark.createDataFrame([tuple((base | c).values()) + (w,) for c, w in cases], kinds).withColumn("published", F.col("published").cast("timestamp"))
    out = candidates.labelled(rows, upkeep.outcome_rules("2024-01-31 00:00:00"), upkeep.OTHERWISE).collect()
    assert [r.outcome for r in out] == [w for _, w in cases]


def test_ledger_and_limits(spark):
    from newsloom.operators import upkeep

    state = spark.createDataFrame([("d1_rows_read:2024-01-17", 1), ("d1_rows_read:2024-01-18", 2), ("a", 3)], "key string, value long")
    assert {r.key for r in upkeep.ledger_kept(state, "2024-01-25").collect()} == {"d1_rows_read:2024-01-18", "a"}
    days = spark.createDataFrame([("2026-08-14",), ("2026-08-15",), (None,)], "d string")
    assert [r[0] for r in days.select(upkeep.limit_of(F.col("d"), {"2026-08-14": 165}, 60)).collect()] == [165, 60, 60]


def test_sentences_are_lazy_and_whole():
    from newsloom.functions.gates import candidates, sentences

    text = "First line here. Second one!\nThird\n\nFourth"
    assert candidates(text) == ["First line here.", "Second one!", "Third", "Fourth"] and next(sentences(text)) == "First line here."
    assert candidates(None) == candidates("") == []
