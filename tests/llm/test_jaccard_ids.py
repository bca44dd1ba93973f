"""Near copies where rows share an id but not their text."""

import random

from newsloom.llm import jaccard

SCHEMA = "doc_id long, text string, source string"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """Component (smallest id) and whether it is kept, of each different (id, text)."""
    keys = sorted({r[:2] for r in rows if r[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets(a[1]), sets(b[1])
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k)[0] for k in keys}


def text(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))


def near(t):
    words = t.split()
    words[-1] = "changed"
    return " ".join(words)


def test_texts_of_one_id_are_judged_each(spark):
    a, b, c, d = (text(k) for k in "abcd")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, near(a), "s"), (7, c, "s"), (9, d, "s"), (9, near(d), "s"), (9, None, "s"), (11, near(c), "s"), (None, a, "s"), (13, near(b), "t"), (13, near(b), "s"), (13, near(b), "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    marks = {r.mark: r.text for r in docs.selectExpr("text", "xxhash64(text) as mark").collect()}
    got = {(r.doc_id, marks[r.mark]): r.component_id for r in jaccard.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == want
    assert want[5, b] == 5 and want[7, c] == 7 and want[7, near(a)] == 3
    kept = [tuple(r) for r in jaccard.keep_one_of_each(docs).collect()]
    of_nine = [r for r in kept if r[0] == 9 and r[1]]
    assert len(of_nine) == 1 and of_nine[0][1] in (d, near(d))
    assert sorted((r for r in kept if r not in of_nine), key=str) == sorted([(3, a, "s"), (5, b, "s"), (7, c, "s"), (9, None, "s"), (None, a, "s")], key=str)


def test_one_of_repeated_rows_whatever_the_partitions(spark):
    rows = [(1, text("e"), s) for s in "zcab"] + [(2, None, s) for s in "yx"] + [(4, near(text("e")), "a")]
    for parts in (1, 5):
        got = sorted(tuple(r) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select("doc_id", "source").collect())
        assert got == [(1, "a"), (2, "x")]
