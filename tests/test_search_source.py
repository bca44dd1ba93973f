"""The search source: batch and stream, filters, clamps, the rule of retries, and pages that can't be used."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.sources import search
from newsloom.sources.landed import rotation

RESULTS = "slot int, query string, page int, place int, title string, link string, description string, pub_date string"


def results(slots, pages=2, size=3, each=2):
    return [(s, q, p, i, f"기사 {q} {i} - 어느신문", f"https://x.kr/{s}/{p}/{i}", "설명 &amp; 글", "2024-01-01") for s in slots for q in rotation(s, each) for p in range(1, pages + 1) for i in range(size)]


def options(path, service="naver", size=3, **more):
    return {"path": str(path), "service": service, "key": "k", "size": size, "pages": 2, "each": 2} | more


@pytest.fixture()
def landed(spark, tmp_path):
    search.register(spark)
    search.land(spark.createDataFrame(results((3, 4)), RESULTS), str(tmp_path / "land"), "naver", 3)
    return tmp_path / "land"


def put(path, slot, query, page, *tries, service="naver", size=3):
    folder = path / f"slot={slot}" / f"request={search.request_key(service, query, page, size)}"
    for f in folder.glob("*"):
        f.unlink()
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "answer.txt").write_text("\n".join(json.dumps({"attempt": i, "status": s, "body": b}) for i, (s, b) in enumerate(tries)))


def read(spark, path, **more):
    return spark.read.format(search.FORMAT).options(**options(path, **more)).load()


def test_rows_and_filters(spark, landed):
    got = read(spark, landed)
    assert got.rdd.getNumPartitions() == 8
    rows = sorted((r.slot, r.query, r.page, r.ordinal, r.title, r.link, r.originallink, r.description, r.pub_date, r.source) for r in got.collect())
    assert rows == sorted((s, q, p, i, t.removesuffix(" - 어느신문"), link, link, "설명 & 글", d, "NAVER") for s, q, p, i, t, link, _, d in results((3, 4)))
    query = rotation(3, 2)[0]
    one = got.filter((F.col("query") == query) & (F.col("page") == 2) & (F.col("ordinal") > 0))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 2
    assert got.filter(F.col("query").isin(rotation(4, 2)) & (F.col("query") == query)).count() == 0


def stream(spark, path, folder, name):
    s = spark.readStream.format(search.FORMAT).options(**options(path)).load()
    q = s.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def test_stream_gives_what_batch_gives_and_goes_on_after_a_restart(spark, landed, tmp_path):
    assert sorted(stream(spark, landed, tmp_path, "a").collect()) == sorted(read(spark, landed).collect())
    search.land(spark.createDataFrame(results((5,)), RESULTS), str(tmp_path / "more"), "naver", 3)
    (tmp_path / "more" / "slot=5").rename(landed / "slot=5")
    after = stream(spark, landed, tmp_path, "b")
    assert sorted(after.collect()) == sorted(read(spark, landed).collect()) and after.count() == 36


def test_sizes_are_clamped():
    assert [search.page_size("naver", n) for n in (-1, 0, 7, 100, 101)] == [1, 1, 7, 100, 100]
    assert [search.page_size("kakao", n) for n in (0, 50, 51)] == [1, 50, 50]
    assert search.request_key("naver", "바둑", 2, 500) == search.request_key("naver", "바둑", 2, 100) != search.request_key("naver", "바둑", 1, 100)


def test_key_of_column(spark):
    for service in search.SERVICES:
        got = spark.createDataFrame([("바둑 대회", 3)], "q string, p int").select(search.request_key_c(service, F.col("q"), F.col("p"), 7)).first()[0]
        assert got == search.request_key(service, "바둑 대회", 3, 7)


def tried(*answers, **more):
    waits, asked = [], []

    def fetch(n):
        asked.append(n)
        if isinstance(answers[n], Exception):
            raise answers[n]
        return answers[n], "body"

    try:
        out = search.answered(fetch, sleep=waits.append, **more)
    except Exception as e:
        out = e
    return out, asked, waits


def test_retries():
    assert tried(200) == ((200, "body"), [0], [])
    assert tried(503, 200) == ((200, "body"), [0, 1], [0.25])
    assert tried(TimeoutError(), 500, 404) == ((404, "body"), [0, 1, 2], [0.25, 0.5])
    out, asked, waits = tried(500, 502, 503)
    assert isinstance(out, search.SearchError) and "503" in str(out) and asked == [0, 1, 2] and waits == [0.25, 0.5]
    assert "in time" in str(tried(*[TimeoutError()] * 3)[0])
    assert tried(OSError("a"), 200)[0] == (200, "body") and isinstance(tried(OSError("a"), OSError("b"), OSError("c"))[0], OSError)


@pytest.mark.parametrize(
    "tries, told",
    [([(404, "")], "answered 404"), ([(500, ""), (503, ""), (502, "")], "answered 502"), ([(200, "<html>")], "can't be read"), ([(200, "[1]")], "can't be read"), ([], "nothing in time")],
)
def test_bad_pages_fail(spark, landed, tries, told):
    put(landed, 3, rotation(3, 2)[0], 1, *tries)
    with pytest.raises(PySparkException, match=told):
        read(spark, landed).collect()


def test_second_try_and_empty_answer(spark, landed):
    put(landed, 3, rotation(3, 2)[0], 1, (500, ""), (200, json.dumps({"items": [{"title": "둘째", "link": "l"}]})))
    put(landed, 3, rotation(3, 2)[1], 1, (200, "{}"))
    got = read(spark, landed).filter("slot = 3 and page = 1").collect()
    assert [(r.title, r.link, r.pub_date) for r in got] == [("둘째", "l", "")]


def test_keys(spark, landed):
    with pytest.raises(PySparkException, match="needs a key"):
        read(spark, landed, key="").collect()
    assert read(spark, landed, service="kakao", key="").count() == 0
