"""Budgets against a plain count, and model calls: one a run, with answers checked."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from newsloom.operators import calls
from newsloom.plans import flows, queries
from newsloom.plans.standin import Tables
from newsloom.providers import Rules

QUESTIONS = "run string, kind string, place long, id long, title string"


#: A provider whose answer stands in the first title.
TOLD = """
class Told:
    def judge(self, titles, known):
        if titles[0] == "raise":
            raise OSError("no network")
        return titles[0] + f" // {len(known)} {known[-1]}"

    def retitle(self, titles):
        return titles[0]
"""


@pytest.fixture(scope="module", autouse=True)
def told(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("provider") / "told_provider.py"
    f.write_text(TOLD)
    spark.sparkContext.addPyFile(str(f))


def brute(rows, general, total, cost, daily, monthly):
    called, spent, month, out = {}, {}, {}, {}
    for ordinal, at, bucket in sorted(rows):
        korea = at + timedelta(hours=9)
        d, m = korea.date(), (korea.year, korea.month)
        if called.get(d, 0) >= (total if bucket == "baduk" or korea.hour >= 21 else general):
            out[ordinal] = "calls"
            continue
        called[d] = called.get(d, 0) + 1
        out[ordinal] = "monthly" if month.get(m, 0) + cost > monthly else "daily" if spent.get(d, 0) + cost > daily else ""
        if not out[ordinal]:
            spent[d], month[m] = spent.get(d, 0) + cost, month.get(m, 0) + cost
    return out


@pytest.mark.parametrize("limits", [(24, 60, 15_000, 300_000, 5_000_000), (3, 7, 10, 50, 250), (0, 4, 10, 10**9, 10**9), (5, 5, 10, 20, 60)])
def test_budgets(spark, limits):
    r = random.Random(sum(limits))
    at = datetime(2024, 1, 28)
    rows = []
    for i in range(500):
        at += timedelta(minutes=r.randint(0, 40))
        rows.append((i, at, r.choice(["baduk", "general"])))
    got = calls.admitted(spark.createDataFrame(rows, "ordinal long, at timestamp, bucket string"), (), *limits).collect()
    assert {x.ordinal: x.reason for x in got} == brute(rows, *limits)


def called(spark, rows, task="duplicates", provider="told_provider:Told"):
    return sorted(map(tuple, calls.model_call(spark.createDataFrame(rows, QUESTIONS), task, provider).collect()))


def test_answers_are_checked(spark):
    known = lambda run, n: [(run, "known", i, 100 + i, f"k{i}") for i in range(n)]
    new = lambda run, *titles: [(run, "new", i, i, t) for i, t in enumerate(titles)]
    rows = new("a", '```[{"new": 1, "same": 2}, {"new": 9, "same": 0}, {"new": 0, "same": -1}, {"new": true, "same": 0}, {"new": "0", "same": 0}, 5]```', "b") + known("a", 3)
    rows += new("b", '[{"new": 0, "same": 39}, {"new": 0, "same": 40}]') + known("b", 50)  # the last 40: k10 to k49
    rows += new("c", "raise") + known("c", 1) + new("d", "no list") + known("d", 1) + new("e", '[{"new": 0, "same": 0}]') + known("f", 2)
    assert called(spark, rows) == [("a", 1, 102), ("b", 0, 149)]
    titles = new("a", '[{"index": 0, "title": " ' + "가" * 50 + '"}, {"index": 1, "title": ""}, {"index": 5, "title": "x"}, {"index": 1}]', "b")
    assert called(spark, titles, "titles") == [("a", 0, "가" * 40)]
    assert called(spark, rows[:0]) == []


def test_arguments_are_checked(spark):
    with pytest.raises(PySparkException, match="task must be"):
        calls.model_call(spark.createDataFrame([], QUESTIONS), "sing")
    with pytest.raises(PySparkException, match="rows need id bigint"):
        calls.model_call(spark.createDataFrame([], QUESTIONS.replace("id long", "id string")), "titles")


def test_queries_give_what_one_call_a_run_gives(spark, data):
    t = Tables(spark, data)
    new, known, _ = flows.judged_runs(t)
    new, known = new.collect(), sorted(known.collect(), key=lambda r: (r.at, r.id))
    want = set()
    for run, day in {(r.run, r.day) for r in new}:
        mine = sorted((r for r in new if (r.run, r.day) == (run, day)), key=lambda r: (r.at, r.id))
        before = [k for k in known if k.day == day and k.at <= mine[0].at][-40:]
        if before:
            found = calls.checked("duplicates", Rules().judge([r.title for r in mine], [k.title for k in before]), [(r.id, r.title) for r in mine], [(k.id, k.title) for k in before])
            want |= {(f"{run}|{day}", i, same) for i, same in found.items()}
    assert {tuple(r) for r in queries()["duplicates_judged"](spark, data).collect()} == want
    rows = flows.standalone_titles(t).collect()
    assert max(r.place for r in rows) <= 12
    want = {(r.run, r.id, i[r.id]) for r in rows if (i := calls.checked("titles", Rules().retitle([r.title]), [(r.id, r.title)], []))}
    assert {tuple(r) for r in queries()["titles_rewritten"](spark, data).collect()} == want and want
