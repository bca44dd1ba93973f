"""Clustered layout, bit-sliced search and resampling against brute force, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from newsloom.llm import layout, resample, slices
from newsloom.llm.ranks import places, sums_before
from oracle import connection, rows
from test_llm import DOCS, ROWS
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "z", 1) for r in ROWS], DOCS + ", TEXT string, SOURCE2 long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("module", [layout, slices, resample])
def test_sql(spark, data, module):
    for name, query in module.QUERIES.items():
        found, wanted = query(spark, data).toPandas(), connection(data).execute(module.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


# --- places -----------------------------------------------------------------------------------------------


def test_places_and_sums(spark):
    x = spark.createDataFrame([(i * 7919 % 1000, i % 5) for i in range(3000)], "a int, w int").withColumn("u", F.monotonically_increasing_id())
    got = sorted((r.a, r.u, r.position) for r in places(x, "a", "u").collect())
    assert [p for *_, p in got] == list(range(3000))
    before, total = {}, 0
    for r in sorted(sums_before(x, "w", "a", "u").collect(), key=lambda r: (r.a, r.u)):
        before[r.u] = (r.before, total)
        total += r.w
    assert all(a == b for a, b in before.values())
    assert places(x.limit(0), "a").count() == 0


# --- 11 layout --------------------------------------------------------------------------------------------


def brute_layout(data, per_file):
    def key(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)

    values = [(i, s, g, -1 if t is None else len(t.encode()), zlib.crc32(("" if i is None else str(i)).encode()) % 365) for i, t, g, s, _ in data]
    n = len(values)
    cells = []
    columns = [sorted(key(v[d]) for v in values) for d in range(1, 5)]
    for v in values:
        c = [8 * columns[d - 1].index(key(v[d])) // n for d in range(1, 5)]
        z = 0
        for digit in (2, 1, 0):
            for x in c:
                z = z * 2 + (x >> digit & 1)
        cells.append((z, key(v[0]), v[0], c))
    cells.sort(key=lambda x: x[:2])
    files = [cells[k : k + per_file] for k in range(0, n, per_file)]
    ends = [[(min(r[3][d] for r in f), max(r[3][d] for r in f)) for d in range(4)] for f in files]
    out = []
    for at, (z, _, i, c) in enumerate(cells):
        reach = (0, 0, 1, 1)
        touched = sum(all(lo <= x + r and hi >= x - r for (lo, hi), x, r in zip(e, c, reach)) for e in ends)
        matching = sum(any(all(abs(a - x) <= r for a, x, r in zip(row[3], c, reach)) for row in f) for f in files)
        out.append((i, z, at, at // per_file, touched, matching, ",".join(str(x) for e in ends[at // per_file] for x in e)))
    return out


@pytest.mark.parametrize("per_file", [1, 3, 1000])
def test_layout_is_that_of_brute_force(docs, per_file):
    got = layout.cluster_documents(docs, per_file=per_file)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == brute_layout(ROWS, per_file)


def test_layout_of_one_value_and_of_nothing(spark, empty):
    same = spark.createDataFrame([(None, None, None, None, None)] * 7, DOCS)
    got = layout.cluster_documents(same, per_file=2).collect()
    assert sorted(r.position for r in got) == list(range(7)) and {(r.z, r.files_touched, r.files_matching, r.file_bounds) for r in got} == {(0, 4, 4, "0,0,0,0,0,0,0,0")}
    assert layout.cluster_documents(empty).count() == 0


def test_words_of_files_and_written_files(spark, docs, tmp_path):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 17).alias("y"))
    ends = layout.write_files(many, {"x": F.col("x"), "y": F.col("y")}, "doc_id", str(tmp_path / "files"), buckets=16, per_file=10).collect()
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "files").glob("*.parquet")]
    assert sum(sizes) == 3000 and set(sizes) == {10} and len(ends) == 300
    assert spark.read.parquet(str(tmp_path / "files")).columns == many.columns
    index = layout.cover_index(spark.createDataFrame(ends), 2, 16)
    assert index.count() == 5  # words of 64 files
    got = {(r.q0, r.q1): r.files_touched for r in layout.files_touched(index, [2, 0], 16).collect()}
    brute = collections.Counter((a, b) for a in range(16) for b in range(16) for e in ends if e.low0 <= a + 2 and e.high0 >= a - 2 and e.low1 <= b <= e.high1)
    assert got == dict(brute)


# --- 12 search --------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, VEC_ID2 long"


def vectors():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((400, 12)) / 4).astype(np.float32)
    x[50:60] = x[0]  # ties
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(400, None), (401, []), (402, [0.5] * 11 + [None]), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (405, [0.0] * 12), (406, [3e38] * 12)]
    out += [(7, out[9][1]), (100, out[101][1]), (None, out[0][1]), (450, [0.25, -0.5]), (451, [1.0, 2.0]), (452, [-3.0, 70000.0])]
    return [(*r, 1, 2) for r in out]


def brute_search(data, k):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e, *_ in data if e and all(x is not None and math.isfinite(x) and abs(x) < 1e30 for x in e)]
    out = []
    for own, q in v:
        if own is not None and own % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, x)), i is None, i or 0) for i, x in v if i != own and len(x) == len(q)))[:k]
            out += [(own, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block", [(5, 1 << 15), (5, 64), (1, 37), (500, 128)])
def test_search_is_that_of_brute_force(spark, k, block):
    got = slices.top_vectors(spark.createDataFrame(vectors(), VECTORS).repartition(3), k=k, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(vectors(), k)


def test_search_of_nothing(spark):
    assert slices.top_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert slices.top_vectors(spark.createDataFrame([(0, [1.0], 1, 1)], VECTORS)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(8)
    bits = {w: rng.integers(0, 2, (int(n), 128), dtype=np.uint8) for w, n in enumerate([1, 7, 0, 30, 2])}
    packed = {w: [np.packbits(b, axis=1, bitorder="little").view(np.uint64)] for w, b in bits.items() if len(b)}
    want = sum((b.sum(0, dtype=np.int64) << w) for w, b in bits.items())
    got = np.zeros(128, np.int64)
    for w, s in enumerate(slices.add_slices(packed)):
        if s is not None:
            got += np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << w
    assert (got == want).all()


# --- 13 resampling ----------------------------------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10000


def brute_resample(data, target):
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in data], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s | t}
    out = []
    for i, text, *_ in data:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


TARGET = ["The quick brown fox", ROWS[5][1], None, "", ROWS[7][1]]


def test_resample_is_that_of_brute_force(spark, docs, empty):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resample.resample(docs, target)
    assert got.dtypes == [(x, "bigint") for x in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(ROWS, TARGET)
    assert resample.resample(empty, target).count() == 0
    assert sorted(map(tuple, resample.resample(docs, target.limit(0)).collect()), key=str) == brute_resample(ROWS, [])


def test_repeated_rows_are_drawn_one_by_one(spark):
    data = [(1, "a " * 30, "en", "s", 1)] * 50 + [(2, "b " * 30, "en", "s", 1)] * 10
    got = resample.resample(spark.createDataFrame(data, DOCS), spark.createDataFrame([("b b",)], "text string")).collect()
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, 16))
    assert sorted(map(tuple, got), key=str) == brute_resample(data, ["b b"])


def test_long_texts_in_pieces():
    rng = np.random.default_rng(2)
    texts = [None, "", "x", *["".join(rng.choice(list("abcÄß漢 .\n"), int(n))) for n in (30, 300, 3000)], "w" * 5000 + " e", "q " * 900]
    for most in (1, 16, 100, 1 << 20):
        words, runs = collections.Counter(), collections.defaultdict(collections.Counter)
        for first, n, owner, crc in resample.runs_of(texts, most):
            for k, x in enumerate(n.tolist()):
                words[first + k] += x
            for k, c in zip(owner.tolist(), crc.tolist()):
                runs[first + k][c] += 1
        for i, t in enumerate(texts):
            w, f = features(t)
            assert words[i] == len(w) and runs[i] == collections.Counter(zlib.crc32(x.encode()) for x in f), (i, most)


def test_kth_key(spark):
    rng = np.random.default_rng(4)
    data = [(int(a), int(b)) for a, b in zip(rng.integers(-5, 5, 300), rng.choice([-(1 << 63), -1, 0, 5, (1 << 63) - 1], 300))]
    frame = spark.createDataFrame(data, "a long, b long")
    for k in (1, 2, 150, 299, 300):
        assert resample.kth(frame, ["a", "b"], k) == sorted(data)[k - 1]
        assert resample.kth(frame, ["b"], k) == (sorted(b for _, b in data)[k - 1],)
    assert resample.kth(frame, ["a"], 0) is None and resample.kth(frame, ["a"], 301) is None
