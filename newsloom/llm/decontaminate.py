"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items;
each text is scanned once and hits are mapped back to offsets of the original.

The automaton is broadcast as the items it is built from, and built once in a worker process. A benchmark of more than
MOST_BENCHMARK_BYTES is cut into shards of windows, each within the bound; documents are then scanned once a shard, and the
hits of all shards are united."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pick, place, table, text_batches, written

WINDOW = 13
#: ASCII but letters and digits separates words; A-Z becomes a-z.
_TO = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: The automaton is built in every Python worker, so its text must be of a proven size; about 40 bytes of automaton a byte of window.
MOST_BENCHMARK_BYTES = 4 << 20
PIECE = 1000  # windows; longer items are cut into pieces of so many, which overlap by a window less a word

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO).split()


def windows_of(text: str | None, size: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def automaton(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> ahocorasick.Automaton:
    """Windows as ' w1 w2 ... ', with the number of words and the ids of their items."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        for w in windows_of(text, size):
            found.setdefault(w, set()).update([] if item_id is None else [item_id])
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(f" {b' '.join(w).decode('utf-8', 'surrogatepass')} ", (len(w), tuple(sorted(ids))))
    auto.make_automaton()
    return auto


_built: dict = {}


def _kept(key: str, items: list, size: int) -> ahocorasick.Automaton:
    """The automaton of this key, built once in a worker process; the one before it goes."""
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items, size)
    return _built[key]


def hits(auto, text: str | None) -> tuple[int, bytearray, set[str]]:
    """Words, which of them are hit (empty: none), items found."""
    words = words_of(text)
    if not words or not len(auto):
        return len(words), bytearray(), set()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(auto.iter(line))
    if not found:
        return len(words), bytearray(), set()
    ends, at, seen = {}, 0, -1
    for end, _ in found:  # ends come in ascending order
        if end != seen:
            at += line.count(" ", seen + 1, end + 1)
            ends[end] = at - 1  # words before this space
            seen = end
    hit = bytearray(len(words))
    items: set[str] = set()
    for end, (n, ids) in found:
        k = ends[end]
        hit[k - n : k] = b"\1" * n
        items.update(ids)
    return len(words), hit, items


def spans_of(text: str | None, hit: bytearray) -> list[dict]:
    """Merged spans of the words hit, in code points of the original text."""
    spans: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text) if any(hit) else ()):
        if hit[i]:
            if last == i - 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = i
    return spans


def scan(auto, text: str | None) -> tuple[int, int, list[str], list[dict]]:
    """Words, words hit, items found, merged spans of the original text in code points."""
    n, hit, items = hits(auto, text)
    return n, sum(hit), sorted(items), spans_of(text, hit)


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """Items as (item_id, text) of PIECE windows at most: no window is lost and none is made."""

    def run(batches):
        for b in text_batches(batches):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                rows += [(item, b" ".join(w[i : i + PIECE + size - 1]).decode("utf-8", "surrogatepass")) for i in range(0, max(1, len(w) - size + 1), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "text"])

    return items.mapInArrow(run, "item_id string, text string")


def _shards(benchmark: DataFrame, most_bytes: int, size: int) -> list:
    """Broadcast lists of (item, text), each of about most_bytes of text at most, and a key for each."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes) or 1
    if n > 1:
        n *= 2  # as a hash deals them out, some shards get more than others
        items = written(_pieces(items, size).withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark-pieces")
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        part = items.filter(F.col("shard") == k).drop("shard") if n > 1 else items
        yield n, k, context.broadcast([tuple(r) for r in part.collect()]), uuid.uuid4().hex


def _first_shards(docs: DataFrame, benchmark: DataFrame, size: int, most_bytes: int, text: str):
    """(docs with the words hit of all shards but the last as 'hit' and their items as 'found', the last shard's items and key).
    A benchmark of one shard leaves docs as they are."""
    for n, k, sent, key in _shards(benchmark, most_bytes, size):
        if k == n - 1:
            return docs, sent, key
        at, old = docs.columns.index(text), len(docs.columns) - 2 if k else None

        def run(batches, sent=sent, key=key, at=at, old=old):
            auto = _kept(key, sent.value, size)
            for b in text_batches(batches, text=text):
                texts = b.column(at).to_pylist()
                before = zip(b.column(old).to_pylist(), b.column(old + 1).to_pylist(), strict=True) if old else [(b"", [])] * len(texts)
                united = [_united(hits(auto, t), *x) for t, x in zip(texts, before, strict=True)]
                columns = list(b.columns[:old]) + [pa.array([bytes(x[1]) for x in united], pa.binary()), pa.array([sorted(x[2]) for x in united], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:old], "hit", "found"])

        plain = docs.drop("hit", "found")
        fields = [*plain.schema.fields, T.StructField("hit", T.BinaryType()), T.StructField("found", T.ArrayType(T.StringType()))]
        docs = written(docs.mapInArrow(run, T.StructType(fields)), "benchmark-hits")


def _united(now: tuple[int, bytearray, set[str]], hit: bytes, items: list[str]) -> tuple[int, bytearray, set[str]]:
    """hits() of one shard with those of the shards before it."""
    n, mine, found = now
    both = bytearray(x | y for x, y in zip(mine, hit, strict=True)) if mine and hit else mine or bytearray(hit)
    return n, both, found.union(items)


def _judged(batch: pa.RecordBatch, auto, at: int) -> list[tuple[int, bytearray, set[str]]]:
    """hits() of each text of a batch, with what earlier shards found."""
    now = [hits(auto, t) for t in batch.column(at).to_pylist()]
    if "hit" not in batch.schema.names:
        return now
    before = zip(batch.column("hit").to_pylist(), batch.column("found").to_pylist(), strict=True)
    return [_united(x, *y) for x, y in zip(now, before, strict=True)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = MOST_BENCHMARK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (ids of the items found, as sorted strings), spans.

    Null or wordless text: no words, nothing found. Items without words are never found; items with a null id hit words but
    are not listed; items that share an id count as one. Over most_bytes of benchmark take a scan a shard. Empty tables give no
    rows or no hits. Repeated rows are judged alike; other columns are not looked at."""
    docs, sent, key = _first_shards(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), benchmark, size, most_bytes, "text")

    def run(batches):
        auto = _kept(key, sent.value, size)
        for b in text_batches(batches):
            rows = _judged(b, auto, 1)
            spans = [spans_of(t, x[1]) for t, x in zip(b.column(1).to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([sum(x[1]) for x in rows], pa.int64()), pa.array([sorted(x[2]) for x in rows], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = MOST_BENCHMARK_BYTES) -> DataFrame:
    """The rows that are not contaminated, all columns whatever their names. Null and wordless texts stay, as do all rows if the
    benchmark is empty; an empty table gives an empty result; repeated rows go or stay alike."""
    at, plain = place(docs, "text"), numbered(docs)
    found, sent, key = _first_shards(plain, benchmark, size, most_bytes, f"c{at}")

    def run(batches):
        auto = _kept(key, sent.value, size)
        for b in text_batches(batches, text=f"c{at}"):
            keep = [not any(hit) or 20 * sum(hit) < n for n, hit, _ in _judged(b, auto, at)]
            yield b.select(list(plain_names)).filter(pa.array(keep, pa.bool_()))

    plain_names = tuple(plain.columns)
    return found.mapInArrow(run, plain.schema).toDF(*docs.columns)


def contaminated():
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


HITS_SQL = r"""
bench_words AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bench_at AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bench_words WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bench_at),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
doc_at AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
found AS (SELECT d.rid, wins.item, d.i, d.n FROM doc_at d JOIN wins ON d.n = wins.n AND array_to_string(d.w[d.i:d.i + d.n - 1], ' ') = wins.win),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid),
judged AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(i.listed, '')) AS items_sha256, (coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w)) AS contaminated
    FROM doc_words d LEFT JOIN hits h ON d.rid = h.rid LEFT JOIN items i ON d.rid = i.rid)"""

ORACLE = {"op8_decontaminate": "WITH " + HITS_SQL.format(docs="documents").strip() + "\nSELECT * FROM judged"}
QUERIES = {"op8_decontaminate": op8_decontaminate}
