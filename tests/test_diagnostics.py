"""Diagnostics out of messages of any shape, and the 21 checks on figures of tables."""

import json
from datetime import datetime, timedelta

from newsloom.operators import diagnostics, reports

NOW = "2024-01-02 00:00:00"
T0 = datetime(2024, 1, 1, 12)
RUNS = "id long, started_at timestamp, finished_at timestamp, status string, message string"
ARTICLES = "id long, url string, url_key string, title string, category string, published_at string, fetched_at string, summary string, summary_quality string, body_text string"


def runs(spark, *messages):
    told = [m if m is None or isinstance(m, str) else json.dumps(m) for m in messages]
    return spark.createDataFrame([(i, T0 + timedelta(hours=i), T0 + timedelta(hours=i, minutes=5), "ok", m) for i, m in enumerate(told)], RUNS)


def d(**x):
    return {"diagnostics": x}


def test_leaves_at_any_depth(spark):
    deep = {"a": {"b": {"c": {"e": {"f": {"g": {"h": {"i": 2}}}}}}}, "n": 1.5, "text": "7", "list": [1, 2], "none": None, "yes": True}
    got = diagnostics.leaves(runs(spark, deep, {"n": 2, "a": 5}, None, "", "{", "[1]", "3", {}, {"a": {"b": 1}})).collect()
    assert {(r.path, r.runs, r.total) for r in got} == {("$.a.b.c.e.f.g.h.i", 1, 2.0), ("$.n", 2, 3.5), ("$.a", 1, 5.0), ("$.a.b", 1, 1.0)}
    assert diagnostics.leaves(runs(spark, None)).count() == 0


def test_rejections(spark):
    got = diagnostics.rejections(runs(spark, d(summary_rejected_by_rule={"short": 2, "promo": "3"}), d(summary_rejected_by_rule={"short": 1, "odd": "x"}), d(summary_rejected_by_rule=[1]), d(), "{"))
    assert {tuple(r) for r in got.collect()} == {("short", 3), ("promo", 3), ("odd", 0)}


def test_run_figures(spark):
    quota = lambda used, seen=1, why="daily_total": d(anthropic_exhausted_reason=why, processed_by_category={"baduk": seen}, anthropic_calls_by_bucket={"baduk": used})
    messages = [
        quota(35), quota(36), quota(0, 0), quota(0, "2", "bucket_baduk"), quota(0, 1, "bucket_general"),
        d(subrequests_used=0, body_too_short_hosts={"x|Too many subrequests": 9, "y|TOO MANY SUBREQUESTS": 1, "z|http_403": 1}), d(body_too_short_hosts={"x|Too many subrequests": 1}),
        d(candidate_outcomes_by_category={"baduk": {"body_too_short": 4, "inserted_publishable": 1, "existing_repaired": 2, "inserted_duplicate": 50}, "general": {"body_too_short": 100}}),
        d(candidate_outcomes_by_category={"baduk": None}), d(candidate_outcomes_by_category=7), d(summary_rejected_by_rule={"a": 11}), {"other": 1}, "{", None,
    ]
    r = diagnostics.run_figures(runs(spark, *messages)).first()
    assert (r.quota_blocked, r.baduk_seen, r.budget_exceeded, r.baduk_short, r.baduk_published, r.paid_rejected) == (2, 5, 2, 4, 3, 11)
    empty = diagnostics.run_figures(spark.createDataFrame([], RUNS)).first()
    assert set(empty) == {0}


def test_recent_runs(spark):
    r = diagnostics.recent(runs(spark, *[d()] * 14, "nothing"), "2024-01-02 14:30:00", most=3)
    assert sorted(x.id for x in r.collect()) == [11, 12, 13]


def checked(spark, articles=(), told=(), state=()):
    a = spark.createDataFrame([(i, f"https://{host}/{i}", f"k{i}", title, category, at, at, "첫째 문장입니다", quality, "본문") for i, (host, title, category, at, quality) in enumerate(articles)], ARTICLES)
    attempts, checks = spark.createDataFrame([(f"k{i}", 30) for i in range(20)], "url_key string, attempts long"), spark.createDataFrame([], "url_key string")
    figures = diagnostics.health_figures(a, attempts, checks, spark.createDataFrame(list(told), RUNS), spark.createDataFrame(list(state), "key string, value string"), NOW)
    return set(reports.health_checks(figures).first().failures)


def test_checks(spark):
    at = "2024-01-01 20:00:00"
    good = [("baduk.or.kr", "신진서 우승", "바둑", at, "full"), ("n.kr", "하늘 맑음 소식", "일반", at, "full")]
    run = (1, datetime(2024, 1, 1, 23), datetime(2024, 1, 1, 23, 5), "ok", json.dumps(d(mode="scheduled", processed_by_category={"baduk": 3})))
    state = [("baduk_source_latest", "2024-01-01"), ("database_bytes", "1000")]
    assert checked(spark, good, [run], state) == set()
    assert checked(spark) == {"last_run_ok", "last_run_within_6h", "automatic_run_within_4h", "general_has_recent_news"}
    bad_state = [("baduk_source_latest", "2024-01-02"), ("ai_blocked", "1"), ("claude_monthly_micro_usd", "5000000"), ("d1_rows_read", "1000000"), ("database_bytes", str(400 << 20))]
    assert checked(spark, good, [run], bad_state) == {"baduk_source_collected", "cloudflare_not_provider_blocked", "claude_under_hard_limit", "d1_reads_under_daily_limit", "database_storage_below_70_percent"}
    twice = [*good, *[("n.kr", f"태풍 돌핀 북상 제주 {x}", "일반", at, "full") for x in ("비상", "대응", "피해")]]
    assert checked(spark, twice, [run], state) == {"duplicate_paid_summaries_low"}
    hidden = [("baduk.or.kr", "날씨 소식", "바둑", at, "full"), ("baduk.or.kr", "시장 소식", "바둑", at, "full"), good[1]]
    assert checked(spark, hidden, [run], state) == {"baduk_reaches_screen", "baduk_display_not_over_filtered"}
    running = (2, datetime(2024, 1, 1, 23, 50), None, "running", "{}")
    assert checked(spark, good, [run, running], state) == set()
    stuck = (2, datetime(2024, 1, 1, 23, 30), None, "running", "{}")
    assert checked(spark, good, [run, stuck], state) == {"last_run_ok", "last_run_within_6h"}
    assert checked(spark, [*good, *[("n.kr", f"제목 {i}", "일반", at, "none") for i in range(18)]], [run], state) == {"summary_exhausted_below_threshold"}
