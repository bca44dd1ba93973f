"""The story window against a fold that goes through the titles one by one."""

import random
import re
from datetime import datetime, timedelta

import pytest

from newsloom.functions import fixed
from newsloom.functions.similarity import _plain, bigrams, dice, without_series
from newsloom.functions.text import clean_title, normalize
from newsloom.operators.storywindow import story_window
from newsloom.plans import queries

ROWS = "id long, title string, category string, at timestamp, summary string, summary_quality string"
NOW = "2024-03-10 00:00:00"
T0 = datetime(2024, 3, 8, 16)  # 01:00 of the 9th in Korea


def same(a, b):
    def prints(t):
        two = clean_title(clean_title(t))
        return two, _plain(clean_title(two)), _plain(clean_title(without_series(two))), set(re.findall("[0-9]{3,}", two))

    (_, w, t, s), (_, x, u, r) = prints(a), prints(b)
    near = lambda p, q: bool(p and q) and (p == q or dice(bigrams(p), bigrams(q)) >= 0.45)
    return not (s and r and not s & r) and near(w, x) and near(t, u)


def words(t):
    return {w for w in re.findall("[0-9A-Za-z가-힣]{2,}", clean_title(t)) if w not in fixed.TITLE_STOPWORDS and not w.isdigit()}


def fold(stored, candidates):
    full = lambda r: r[5] == "full" and bool((r[4] or "").strip()) and bool((r[1] or "").strip())
    day = lambda r: r[3] and (r[3] + timedelta(hours=9)).date()
    known = {}
    for r in sorted((r for r in stored if r[3] and r[3] >= datetime(2024, 3, 3) and full(r)), key=lambda r: (r[3], r[0])):
        known.setdefault(day(r), []).append(r)
    out = {}
    for r in sorted((r for r in candidates if r[3]), key=lambda r: (r[3], r[0])):
        before = known.setdefault(day(r), [])
        story = next((k for k in before if same(k[1], r[1] or "")), None)
        shared = next((k for k in before if r[2] != "바둑" and len(words(k[1]) & words(r[1] or "")) >= 3), None)
        hit = story or shared
        out[r[0]] = (hit and hit[0], "story" if story else "words" if shared else None, not hit and full(r))
        if out[r[0]][2]:
            before.append(r)
    return out | {r[0]: (None, None, False) for r in candidates if not r[3]}


def held(spark, stored, candidates, first_batch=64):
    got = story_window(spark.createDataFrame(stored, ROWS), spark.createDataFrame(candidates, ROWS), NOW, first_batch=first_batch).collect()
    assert len(got) == len(candidates)
    assert {r.id: (r.duplicate_of, r.by, r.joined) for r in got} == fold(stored, candidates)


def test_cases(spark):
    at = lambda n: T0 + timedelta(minutes=n)
    row = lambda i, t, c="일반", n=None, s="요약", q="full": (i, t, c, at(i if n is None else n), s, q)
    stored = [
        row(1, "태풍 돌핀 북상 제주 비상 대응", n=-2000), row(2, "태풍 돌핀 북상 제주 비상", n=1), (3, "지난달 이야기", "일반", datetime(2024, 2, 20), "요약", "full"),
        row(4, "요약 없는 기사 제목입니다", s=" "), row(5, "요약 나쁜 기사 제목입니다", q="none"),
    ]
    candidates = [
        row(10, "태풍 돌핀 북상 제주 비상 - 어느신문"), row(11, "요약 없는 기사 제목입니다"), row(12, "요약 나쁜 기사 제목입니다", q="none"), row(13, "요약 나쁜 기사 제목입니다"), row(14, "요약 나쁜 기사 제목입니다"),
        row(20, "[용어산책 1870] 에이징 커브라고 말할까"), row(21, "[용어산책 1869] 정선 편 이야기"), row(22, "[용어산책 1870] 에이징 커브라고 말할까요"),
        row(30, "기원에서 말다툼하다 흉기 휘둘러 지인 살해 60대 남성"), row(31, "서울 노원구 지인 흉기 살해 60대 구속"), row(32, "서울 노원구 지인 흉기 살해 60대 구속", "바둑"),
        row(40, "[동정]"), row(41, "[동정]"), row(42, ""), row(43, None), row(44, "가"), row(45, "가"), (46, "가", "일반", None, "요약", "full"), row(47, "지난달 이야기"),
        (48, "태풍 돌핀 북상 제주 비상", "일반", datetime(2024, 1, 5), "요약", "full"), (49, "태풍 돌핀 북상 제주 비상", "일반", datetime(2024, 1, 5), "요약", "full"),
    ]
    held(spark, stored, candidates)
    held(spark, [], candidates)
    held(spark, stored, [])


@pytest.mark.parametrize("seed, first_batch", [(1, 64), (2, 24)])
def test_any_order_of_any_titles(spark, seed, first_batch):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("가나다라마바사아자차카타파하") for _ in range(r.randint(2, 3))) for _ in range(14)] + ["1870", "1869", "60대"]
    title = lambda: r.choice(["", "", "[산책] ", "【속보】"]) + " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6))) + r.choice(["", " - 신문", " | 뉴스 - 일보"])
    rows = [(i, normalize(title()), r.choice(["일반", "일반", "바둑"]), T0 + timedelta(hours=r.randint(-30, 30)), r.choice(["요약"] * 3 + [""]), r.choice(["full"] * 3 + ["none"])) for i in range(120)]
    rows += [(200 + i, rows[0][1], "일반", T0 + timedelta(minutes=i // 2), "요약", "full") for i in range(60)]
    r.shuffle(rows)
    held(spark, rows[:40], rows[40:], first_batch)


def test_query_has_matches_of_both_kinds(spark, data):
    got = queries()["story_index"](spark, data).groupBy("by", "joined").count().collect()
    seen = {(r.by, r.joined): r["count"] for r in got}
    assert seen.get(("story", False)) and seen.get((None, True))


@pytest.mark.parametrize("first_batch", [1, 2, 64])
def test_what_is_published_counts_whatever_it_repeats(spark, first_batch):
    """A published title stays known though an earlier one tells its story."""
    row = lambda i, t: (i, t, "일반", T0 + timedelta(minutes=i), "요약", "full")
    stored = [row(1, "abcdefghijklmn"), row(2, "abcdefghijuvwxyz"), row(3, "qqqqrrrr ssss")]
    held(spark, stored, [row(4, "ijuvwxyzopq"), row(5, "abcdefghijkl")], first_batch)
