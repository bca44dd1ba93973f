"""Texts, titles, times, addresses and pages, on hand-made cases."""

from newsloom.functions import extract, similarity, text, times
from newsloom.functions.gates import build_summary, general_ok, mentions_title, publishable, rejected_title, rejection_reason, reordered, stored_quality, three_lines_ok
from newsloom.providers import Rules, best_summary, normalised_answer, numbers
from pyspark.sql import functions as F


def test_normalize():
    assert text.normalize("인간 바둑<b>에서도</b> 전대미문") == "인간 바둑에서도 전대미문"
    assert text.normalize("&amp;lt;b&#39; &#x41;&#66; &unknown; &HELLIP;") == "<b' AB &unknown; …"
    assert text.normalize("a\r\n\r\n\r\n\r\nb \t c .") == "a\n\nb c."
    assert text.normalize(None) == ""
    assert text.normalize("&#99999999999;") == "�"


def test_titles_and_press():
    assert text.clean_title("전북바둑협회-장쑤성 청소년 바둑대회 성료") == "전북바둑협회-장쑤성 청소년 바둑대회 성료"
    assert text.clean_title("신진서 우승 - 한국일보") == "신진서 우승"
    assert text.press_from_title("신진서 우승 - 한국일보") == "한국일보"
    assert text.outlet("", "https://n.news.naver.com/article/001/0001", "NAVER") == "연합뉴스"
    assert text.outlet("", "https://x/", "KAKAO") == "다음 뉴스"
    assert text.outlet("", "https://x/", "www.yna.co.kr") == "연합뉴스"
    assert text.outlet("", "", "") == "기타"


def test_junk():
    assert text.is_junk("짧다") and text.is_junk("무단전재 및 재배포 금지 안내입니다") and text.is_junk("#바둑 #대회 소식입니다")
    assert not text.is_junk("신진서 9단이 결승에서 이겼다고 한국기원이 밝혔다")


def test_similarity():
    assert similarity.title_similarity("가나다라", "가나다라") == 1 and similarity.title_similarity("", "가") == 0
    a = similarity.Story("[코너 1870] 바둑에서 왜 에이징 커브라고 말할까 이야기")
    b = similarity.Story("[코너 1869] 바둑에서 왜 에이징 커브라고 말할까 이야기")
    assert not a.same(b)
    assert similarity.Story("태풍 돌핀 북상 제주 비상").same(similarity.Story("태풍 돌핀 북상…제주 비상"))
    assert similarity.same_issue("Sh수협은행 여자바둑최강전", "SH수협은행 여자바둑대회")
    assert not similarity.same_issue("하찬석국수배 영재바둑대회", "하찬석국수배 어린이 바둑대회")
    assert similarity.near_duplicate("1) 한국기원은 오늘 대회를 연다고 밝혔다", "2) 한국기원은 오늘 대회를 연다고 밝혔다.")
    assert similarity.headline_match("a" * 18, "b" + "a" * 18) and not similarity.headline_match("aa", "aaa")


def test_dates():
    assert times.parse_date("2026-08-14") == "2026-08-14" and times.parse_date("2026.8.4") == "2026-08-04"
    assert times.parse_date("2026-08-12 05:10") == "2026-08-11T20:10:00.000Z"
    assert times.parse_date("2026.08.12 오후 2:10") == "2026-08-12T05:10:00.000Z"
    assert times.parse_date("2026-08-12T05:10:00+09:00") == "2026-08-11T20:10:00.000Z"
    assert times.parse_date("2026-08-12 25:10") == times.parse_date("nonsense") == times.parse_date(None) == ""


def test_date_column(spark):
    written = ["2026-08-14", "2026.8.4", "2026-08-12 05:10", "2026.08.12 오후 2:10", "2026.08.12 오전 12:00", "2026/08/12 오후 12:05:09", "2026-08-12T05:10:00+09:00", "2026-08-12 25:10", "2026-08-12 오후 13:10", "nonsense", None, " 2026-01-02 "]
    rows = spark.createDataFrame([(x,) for x in written], "x string").select("x", times.parse_date_c(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [times.parse_date(r.x) for r in rows]


def test_elements():
    page = "<div id='x'><div>a</div><p>b</p></DIV><div>tail</div>"
    assert extract.element(page, 0) == "<div id='x'><div>a</div><p>b</p></DIV>"
    assert extract.element("<div><p>open", 0, fallback=7) == "<div><p" and extract.element("text <b>x</b>", 0, fallback=4) == "text"


def test_addresses():
    c = extract.canonical_url
    assert c("https://M.Example.com/a/?utm_source=x&b=1&referrer=y#top") == "https://example.com/a/?b=1"
    assert c("https://example.com/") == "https://example.com"
    assert c("https://m.sports.naver.com/general/article/079/0004178768") == "https://n.news.naver.com/mnews/article/079/0004178768"
    assert c("not a url") == "not a url" and c(None) == ""


def test_address_columns(spark):
    rows = [("https://x.naver.com/a", "KAKAO"), ("https://v.daum.net/v/1", "KAKAO"), ("https://notdcinside.com/a", "RSS"), ("https://ok.com/", "RSS"), ("nothing", "RSS")]
    df = spark.createDataFrame(rows, "url string, d string")
    assert [r[0] for r in df.select(extract.allowed_c(F.col("url"), F.col("d"))).collect()] == [False, True, False, True, False]
    assert [r[0] for r in df.select(extract.source_c(F.col("url"), F.lit(""))).collect()] == ["NAVER", "DAUM", "notdcinside.com", "ok.com", "기타"]
    s = spark.createDataFrame([("https://a.com/1", "https://sports.news.naver.com/news?oid=001&aid=00123456")], "u string, l string")
    assert s.select(extract.readable_url_c(F.col("u"), F.col("l"))).first()[0] == "https://n.news.naver.com/mnews/article/001/00123456"


LONG = "한국기원은 올해 대회를 새 규정으로 치른다고 밝혔으며 참가자는 두 배로 늘었다. " * 8


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_extract_container_ends():
    html = page(f"<div class='article_view'><p>{LONG}</p><div>안쪽 문장도 본문에 들어가야 합니다.</div></div><p>꼬리 문장은 본문에 들어가면 안 됩니다.</p>")
    out = extract.extract("https://a.com/1", html)
    assert out["status"] == "ok" and "꼬리" not in out["body"] and "안쪽" in out["body"]


def test_extract_fields():
    head = """<meta content="https://a.com/i.jpg" property="og:image"><meta property='og:site_name' content='한국일보'>
    <meta property="article:published_time" content="2026-08-14 10:00:00"><meta property="article:section" content="국제">"""
    out = extract.extract("https://a.com/1", page(f"<article itemprop='articleBody'>{LONG}</article>", head))
    assert (out["image"], out["press"], out["published_at"], out["section"]) == ("https://a.com/i.jpg", "한국일보", "2026-08-14T01:00:00.000Z", "세계")
    inside = extract.extract("https://a.com/x/1", page(f"<article class='news_body'><img src='/p.jpg'>{LONG}</article>"))
    assert inside["image"] == "https://a.com/p.jpg"


def test_extract_ld_and_failures():
    ld = '<script type="application/ld+json">{"@graph": [{"articleBody": "' + LONG + '"}]}</script>'
    assert extract.extract("u", page(ld))["status"] == "ok"
    assert extract.extract("u", "", 404)["status"] == "http_404" and extract.extract("u", "", 200, "image/png")["status"] == "non_html"
    assert extract.extract("u", page("요청하신 페이지를 찾을 수 없습니다"))["status"] == "dead_page"
    assert extract.extract("u", page("<p>x</p>"))["status"] == "selector_miss"
    assert extract.decoded("한국기원".encode("euc-kr"), "text/html; charset=euc-kr") == "한국기원"
    assert extract.section("var a = {sectionId: '101'}") == "경제"


GOOD = "1) 신진서 9단이 세계대회 결승에서 중국 선수를 꺾고 우승했다.\n2) 한국기원은 이번 대회 상금이 작년보다 두 배로 늘었다고 밝혔다.\n3) 다음 대회는 오는 시월 서울 성동구 한국기원에서 열릴 예정이다."


def test_gates():
    assert three_lines_ok(GOOD) and publishable(GOOD, "신진서 세계대회 결승 우승 달성", "바둑") and general_ok(GOOD, "신진서 세계대회 결승 우승")
    assert rejection_reason("", "t", "") == "empty" and rejection_reason("1) 한 줄이다", "t", "") == "not_three_lines_1"
    assert rejection_reason(GOOD, "바둑", "바둑") == "rejected_title" and rejected_title("왜?????")
    assert rejection_reason(GOOD.replace("1) 신진서", "1) 그가 신진서"), "t", "바둑") == "dependent_first_line"
    assert rejection_reason(GOOD.replace("결승에서 중국", "결승 조차 중국 처럼"), "t", "바둑") in ("detached_particle", "")
    assert rejection_reason(GOOD.replace("우승했다", "우승"), "t", "바둑") == "three_line_checks"
    assert rejection_reason(GOOD, "여수 엑스포 개막식 불꽃놀이", "바둑") == "title_not_mentioned"
    assert mentions_title(GOOD, "짧은 제목")
    sorry = GOOD.replace("신진서 9단이 세계대회 결승에서 중국 선수를 꺾고 우승했다", "죄송하지만 제공하신 원문에는 기사 내용이 없습니다")
    assert not three_lines_ok(sorry)


def test_reorder_and_build():
    moved = reordered("1) 이후 다른 소식이 이어졌다.\n2) 신진서 결승 우승 소식이다.\n3) 끝이다.", "신진서 결승 우승")
    assert moved.startswith("1) 신진서 결승")
    built = build_summary("제목", "", LONG + "완전히 다른 문장도 하나 더 있어야 요약이 두 줄이 된다고 한다.")
    assert built.startswith("1) 한국기원은") and built.count("\n") == 1
    assert stored_quality("", built)[1] == "short" and build_summary("", None, None) == ""


def test_providers():
    assert numbers("1) 1,234명 중 5.5%") == {"1234", "5.5"}
    assert normalised_answer("```\n" + GOOD + "\n```") == GOOD
    assert best_summary(Rules(), "t", "", "짧다", "바둑") == ""
    body = "\n".join(x[3:] for x in GOOD.split("\n"))
    assert best_summary(Rules(), "신진서 세계대회 우승 상금", "", body, "바둑") == GOOD


def test_columns_agree_with_strings(spark):
    lines = ["1) 한국기원은 오늘 대회를 연다고 밝혔다", "#바둑 #대회 소식입니다", "짧다", "[칼럼] 이야기", "왜?????", "카타고", "구독 버튼을 눌러 주세요 여러분"]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    got = df.select(text.junk_c(F.col("s")), text.rejected_title_c(F.col("s")), text.comparison_key_c(F.col("s")), text.strip_numbering_c(F.col("s"))).collect()
    for line, (junk, rejected, key, plain) in zip(lines, got, strict=True):
        assert (junk, rejected, key, plain) == (text.is_junk(line), rejected_title(line), text.comparison_key(line), text.strip_numbering(line)), line


def test_relevance(spark):
    rows = [("신진서 우승", ""), ("군민속씨름단 우승", ""), ("최정만 장사 등극", ""), ("제목", "바둑 한국기원 대국 소식")]
    got = spark.createDataFrame(rows, "t string, b string").select(text.relevant_c(F.col("t"), F.col("b")), text.display_relevant_c(F.col("t"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (True, True)]
    topics = spark.createDataFrame([("일반", "국회 선거 소식", ""), ("바둑", "무제", "무제"), ("경제", "무제", "경찰 수사")], "c string, t string, b string")
    assert [r[0] for r in topics.select(text.classify_c(F.col("c"), F.col("t"), F.col("b"))).collect()] == ["정치", "기타", "사회"]
