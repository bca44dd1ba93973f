"""Trigrams are found in one pass, and are those of the characters."""

import random

from pyspark.sql import functions as F

from newsloom.operators import search


def test_grams_are_those_of_the_characters(spark):
    r = random.Random(5)
    texts = [None, "", "ab", "😀", "😀😀", "\n\n\n", *("".join(r.choices(["a", "B", "é", "가", "😀", "𝒳", "\n", " ", "%"], k=r.randint(0, 12))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", search._grams(F.col("t")).alias("g")).orderBy("i").collect()
    assert [x.g for x in rows] == [[t[k : k + 3] for k in range(len(t) - 2)] for t in ((x or "").lower() for x in texts)]


def test_no_function_of_single_characters(spark):
    plan = spark.createDataFrame([(1, "a", "b", "c")], "id long, title string, summary string, press string")
    assert "zip_with" not in search.trigrams(plan)._jdf.queryExecution().executedPlan().toString()
