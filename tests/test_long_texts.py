"""Steps over whole texts: as many looks at a text as it is long, and the same results."""

import random
import re
import time

from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions import similarity as S
from newsloom.functions import text as X


def test_rejected_titles_as_by_the_whole_patterns(spark):
    r = random.Random(3)
    words = ["칼럼", "[", "]", "사설]", "abc", "\n", "오피니언", "뉴스", "잇 (", "9월 1일 뉴스 9 예고", "?", "�", "바둑", "신청 및 x 환급 안내", " ", "가나"]
    texts = [None, "", "바둑", *("".join(r.choices(words, k=r.randint(1, 6))) for _ in range(400))]
    whole = "(" + ")|(".join((fixed.REJECTED_BARE, fixed.REJECTED_PROMO, fixed.REJECTED_EDITORIAL)) + ")"
    want = [None if t is None else bool("�" in t or t.count("?") >= 5 or re.search(whole, t, re.I)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.rejected_title_c(F.col("t")).alias("x")).orderBy("i").collect()
    assert [x.x for x in rows] == want and 50 < sum(map(bool, want)) < 400
    assert r"{0,20}" not in X.EDITORIAL_FOUND


def test_chunks_of_a_long_line(spark):
    r = random.Random(4)
    keys = ["", "a", "가나다", *("".join(r.choices("ab가나", k=r.randint(1, 9))) for _ in range(50))]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string").select("i", S.chunks_c(F.col("k")).alias("c")).orderBy("i").collect()
    assert [set(x.c) for x in rows] == [{k[i : i + 2] for i in range(0, len(k), 2)} for k in keys] and all(len(set(x.c)) == len(x.c) for x in rows)
    long = spark.createDataFrame([("".join(r.choices("가나다라마바사아자차카타파하", k=400_000)),)], "k string")
    start = time.perf_counter()
    assert long.select(F.size(S.chunks_c(F.col("k")))).first()[0] == 196
    assert time.perf_counter() - start < 20  # by place it takes minutes


def test_near_duplicate_lines_move_no_text(spark, data):
    from newsloom import plans

    df = plans.queries()["near_duplicate_lines"](spark, data)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
