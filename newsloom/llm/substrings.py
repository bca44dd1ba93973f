"""Substring dedup with suffix automata of reference shards.

A document is streamed through the automaton of reference text; its matching statistics (the longest match that ends at
each word) say which windows of WINDOW words occur in a document with a smaller id, and the words of such windows go.

Broadcasting an automaton of every shard to every document would read the corpus once a shard. So text first finds its
shard: each window has a minimizer (the smallest hash among its K-word runs), equal windows have equal minimizers, and
only minimizers that occur in more than one document matter. The text around each of those, up to where no window with
that minimizer can reach, goes to the minimizer's shard, once for each different text, with the smallest id that has it.
A shard takes its texts in ascending order of id: each is streamed through the automaton of what came before, then
extends it unless all of it was known. Documents get back which of their windows were found."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, pick, table, text_batches, window_hashes, word_hashes, written

WINDOW, K = 50, 10


class SuffixAutomaton:
    """Of a growing list of texts. A new text starts at the root, so no match runs across two texts."""

    __slots__ = ("next", "link", "length", "last")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def start(self) -> None:
        self.last = 0

    def extend(self, c) -> None:
        nxt, link, length, p = self.next, self.link, self.length, self.last
        q = nxt[p].get(c)
        if q is not None:
            if length[q] == length[p] + 1:
                self.last = q
                return
            self.last = self._split(p, q, c)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        self.last = cur

    def _split(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, words) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def minimizers(words: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the minimizer, its place) of each window of the document; the last of equal ones."""
    grams = window_hashes(words, k)
    width = window - k + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.arange(len(view)) + (width - 1 - view[:, ::-1].argmin(axis=1))
    return grams[at], at


def pieces(words: np.ndarray, window: int = WINDOW, k: int = K) -> list[tuple[int, int, int]]:
    """(minimizer as signed long, first window, last window): runs of windows with the same minimizer at the same place."""
    h, at = minimizers(words, window, k)
    if not len(h):
        return []
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([edge[1:], [len(h)]]) - 1
    return list(zip(h[edge].astype(np.int64).tolist(), edge.tolist(), last.tolist(), strict=True))


def _key(doc_id, text: str | None) -> int:
    """Tells rows apart that share an id."""
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _each(batches):
    """(doc_id, text, hashes of the words, spans of the words in bytes, bytes) of each row."""
    for b in text_batches(batches):
        texts = b.column(1).to_pylist()
        words, ptr, starts, ends, buf = word_hashes(texts)
        for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), texts, strict=True)):
            s = slice(ptr[i], ptr[i + 1])
            yield b, i, doc, text, words[s], starts[s], ends[s], buf


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _flow(rows, schema: pa.Schema, most: int = 20_000):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield _table(out, schema)
            out = []
    if out:
        yield _table(out, schema)


def _anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        rows = ((h, doc) for _, _, doc, _, w, *_ in _each(batches) if doc is not None for h in {p[0] for p in pieces(w, window, k)})
        yield from _flow(rows, pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())]))

    return docs.mapInArrow(run, "anchor long, doc_id long")


_CONTEXT = "anchor long, print binary, doc_id long, row long, firsts array<int>, n int, words binary"


def _contexts(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The text around each repeated minimizer (docs has their list), once a document: its words, a fingerprint, where it starts."""
    schema = pa.schema([("anchor", pa.int64()), ("print", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("firsts", pa.list_(pa.int32())), ("n", pa.int32()), ("words", pa.binary())])

    def rows(batches):
        for b, i, doc, text, w, starts, ends, buf in _each(batches):
            wanted = set(b.column(2)[i].as_py())
            row, seen = _key(doc, text), {}
            for anchor, first, last in pieces(w, window, k):
                if anchor in wanted:
                    n = last + window - first
                    words = b" ".join(buf[x:y] for x, y in zip(starts[first : first + n].tolist(), ends[first : first + n].tolist(), strict=True))
                    seen.setdefault((anchor, hashlib.blake2b(words, digest_size=16).digest()), ([], n, words))[0].append(first)
            for (anchor, mark), (firsts, n, words) in seen.items():
                yield anchor, mark, doc, row, firsts, n, words

    return docs.mapInArrow(lambda batches: _flow(rows(batches), schema, 4000), _CONTEXT)


SHARD_STATES = 250_000  # an automaton of so many states is closed, and the next reference text starts another one


def _judge(contexts: DataFrame, window: int) -> DataFrame:
    """(anchor, print, low, known): of each different text, the windows (counted from its start) that a smaller id has."""
    schema = pa.schema([("anchor", pa.int64()), ("print", pa.binary()), ("low", pa.int64()), ("known", pa.list_(pa.int32()))])

    def rows(batches):
        last, shards, waiting, now = None, [], [], None
        for b in batches:
            for anchor, mark, doc, words in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                if anchor != last:
                    last, shards, waiting, now = anchor, [SuffixAutomaton()], [], doc
                if doc != now:  # texts of one document do not count against each other
                    for w in waiting:
                        if len(shards[-1].next) > SHARD_STATES:
                            shards.append(SuffixAutomaton())
                        shards[-1].start()
                        for c in w:
                            shards[-1].extend(c)
                    waiting, now = [], doc
                w = words.split(b" ")
                found = {i - window + 1 for auto in shards for i, n in enumerate(auto.statistics(w)) if n >= window}
                if len(found) < len(w) - window + 1:
                    waiting.append(w)
                yield anchor, mark, doc, sorted(found)

    parts = max(contexts.sparkSession.sparkContext.defaultParallelism, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = contexts.select("anchor", "print", "low", "words").repartition(parts, "anchor").sortWithinPartitions("anchor", "low", "print")
    return shard.mapInArrow(lambda batches: _flow(rows(batches), schema), "anchor long, print binary, low long, known array<int>")


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (the words left, joined by one space).

    Null text: no words. Texts shorter than a window keep all words. A window goes if its words also start in a row with a
    smaller doc_id; rows that share an id do not count against each other, nor do rows with a null id count or lose words.
    Overlapping windows are judged on the input. Other columns are not looked at; empty tables give empty results."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    anchors = written(_anchors(docs, window, k), "substring-anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    wanted = anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    contexts = written(_contexts(docs.join(wanted, "doc_id"), window, k), "substring-contexts")
    different = contexts.groupBy("anchor", "print").agg(F.min("doc_id").alias("low"), F.first("words").alias("words"))
    known = written(_judge(different, window), "substring-known")
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - window).alias("b")))
    # runs of windows as (first, last), counted from the start of the text
    run_start = F.filter("known", lambda x: ~F.array_contains(F.col("known"), x - 1))
    run_end = F.filter("known", lambda x: ~F.array_contains(F.col("known"), x + 1))
    runs = F.arrays_zip(run_start.alias("a"), run_end.alias("b"))
    known = known.select("anchor", "print", "low", runs.alias("runs"))
    places = contexts.select("anchor", "print", "doc_id", "row", "firsts", "n").join(known, ["anchor", "print"])
    gone = places.select("doc_id", "row", "firsts", F.when(F.col("doc_id") > F.col("low"), all_of_it).otherwise(F.col("runs")).alias("runs")).filter("size(runs) > 0")
    gone = written(gone.groupBy("doc_id").agg(F.collect_list(F.struct("row", "firsts", "runs")).alias("gone")), "substring-gone")
    drop_table(anchors)
    drop_table(contexts)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())][: len(names)])

    def rows(batches):
        for b, i, doc, text, w, starts, ends, buf in _each(batches):
            keep = np.ones(len(w), bool)
            row = _key(doc, text)
            for part in b.column(2)[i].as_py() or ():
                if part["row"] == row:
                    for run in part["runs"]:
                        for at in part["firsts"]:
                            keep[at + run["a"] : at + run["b"] + window] = False
            left = np.flatnonzero(keep)
            kept = b" ".join(buf[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True))
            yield (doc, len(w), len(w) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))[: len(names)]

    full = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    return full.mapInArrow(lambda batches: _flow(rows(batches), schema, 1000), T._parse_datatype_string(_OUT + ", kept string" * with_text))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op3_substrings": op3_substrings}
