"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by the forward algorithm; a text's score is the sum over its words. The piece
probabilities are learned by expectation maximisation over a bounded sample of labelled rows: the words are counted and
their expected pieces summed on the executors, so that the driver holds one number a piece and language only."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, filtered, mix, pick, table, text_batches, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The bound of the training sample: documents of a language (by hash), letters of a word.
SAMPLE_DOCS, SAMPLE_LETTERS = 1000, 128
ROUNDS, BUCKETS = 3, 8  # of expectation maximisation; words are dealt out to so many buckets, whose sums are added in order
#: A letter is a word character that is neither a digit or other number nor an underscore.
_RUNS = re.compile(r"[^\W\d_]+")
_SCALE = 100.0  # a factor a byte that keeps products in range
_WIDE = 64  # bytes; longer words are scored one by one
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Numbers such as one half or a roman numeral sign are no letters."""
    found = _RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    out = []
    for w in found:
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


class Pieces:
    """The vocabulary's pieces, found by their length and a hash of their bytes. A piece's number is its place in order of length
    and hash."""

    def __init__(self, pieces: set[bytes]):
        by_length: dict[int, list[bytes]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        self.keys, self.first, self.size = {}, {}, 0
        for n in sorted(k for k in by_length if k):
            a = np.frombuffer(b"".join(by_length[n]), np.uint8).reshape(-1, n)
            self.keys[n], self.first[n] = np.sort(hashes(a, n)[:, 0]), self.size
            self.size += len(a)
        self.most = max(self.keys)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        """All pieces of a vocabulary file, and all single bytes."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(x.split()[0]) for x in f if x.strip()} | {bytes([i]) for i in range(256)})

    def lengths(self) -> np.ndarray:
        return np.repeat([float(n) for n in self.keys], [len(k) for k in self.keys.values()])

    def find(self, a: np.ndarray, n: int) -> np.ndarray:
        """a: rows of bytes. [row, start]: the number of the piece of n bytes that starts there, or -1."""
        want = hashes(a, n)
        keys = self.keys[n]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at + self.first[n], -1)


def hashes(a: np.ndarray, n: int) -> np.ndarray:
    """[row, start]: a hash of the n bytes from start on; up to 8 bytes it tells all strings apart."""
    out = np.zeros((len(a), a.shape[1] - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(256) if n <= 8 else _BASE
        out += a[:, k : a.shape[1] - n + 1 + k]
    return out if n <= 8 else mix(out)


class Lattice:
    """The pieces found at each place of some words: (end, length) with the words that have one there, and the pieces."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.lengths = np.array([len(w) for w in words])
        width = int(self.lengths.max(initial=0))
        self.width = width
        a = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        found = []
        for n in pieces.keys:
            if n <= width:
                ids = pieces.find(a, n)
                ids[np.arange(width - n + 1)[None, :] + n > self.lengths[:, None]] = -1
                for start in np.flatnonzero((ids >= 0).any(axis=0)).tolist():
                    rows = np.flatnonzero(ids[:, start] >= 0)
                    found.append((start + n, n, rows, ids[rows, start]))
        self.found = sorted(found, key=lambda x: x[:2])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """[place, word, language]: scaled probability of the first bytes, over all segmentations. p: [piece, language]."""
        alpha = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        alpha[0] = 1
        for end, n, rows, piece in self.found:
            alpha[end, rows] += alpha[end - n, rows] * p[piece] * _SCALE**n
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        beta[self.lengths, np.arange(len(self.lengths))] = 1
        for end, n, rows, piece in reversed(self.found):
            beta[end - n, rows] += beta[end, rows] * p[piece] * _SCALE**n
        return beta

    def scores(self, p: np.ndarray) -> np.ndarray:
        """[word, language]: log probability."""
        total = self.forward(p)[self.lengths, np.arange(len(self.lengths))]
        return np.log(np.maximum(total, 1e-300)) - self.lengths[:, None] * np.log(_SCALE)


def long_score(pieces: Pieces, word: bytes, p: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """[language]: log probability of one word of any length; only the last places that a piece can reach are kept, and they are
    brought back into range now and then."""
    most = pieces.most
    last = [np.ones(p.shape[1])] + [np.zeros(p.shape[1])] * (most - 1)  # last[k]: the place k before the current one
    log, a = np.zeros(p.shape[1]), np.frombuffer(word, np.uint8)
    for low in range(0, len(a), chunk):
        start = max(0, low - most)
        part = a[start : low + chunk]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(part) + 1)]
        for n in pieces.keys:
            if n <= len(part):
                ids = pieces.find(part[None, :], n)[0]
                for at in np.flatnonzero(ids >= 0).tolist():
                    ends[at + n].append((n, int(ids[at])))
        for end in range(low - start + 1, len(part) + 1):
            new = np.zeros(p.shape[1])
            for n, piece in ends[end]:
                new = new + last[n - 1] * p[piece] * _SCALE**n
            last = [new, *last[:-1]]
            if end % 16 == 0:
                top = np.maximum(np.max(last, axis=0), 1e-300)
                last = [x / top for x in last]
                log += np.log(top)
    return np.log(np.maximum(last[0], 1e-300)) + log - len(a) * np.log(_SCALE)


def spelled(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


def word_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """[word, language]: log probabilities."""
    raw = [spelled(w) for w in words]
    out = np.zeros((len(words), p.shape[1]))
    for at in _chunks(raw, 1 << 16):
        out[at] = Lattice(pieces, [raw[i] for i in at]).scores(p)
    for i, w in enumerate(raw):
        if len(w) > _WIDE:
            out[i] = long_score(pieces, w, p)
    return out


def _chunks(raw: list[bytes], most: int, wide: int = _WIDE):
    """Numbers of the words of up to wide bytes, of like length together, so that a lattice has about most places."""
    order = sorted((i for i in range(len(raw)) if len(raw[i]) <= wide), key=lambda i: len(raw[i]))
    at = 0
    while at < len(order):
        n = at
        while n < len(order) and (n == at or (n - at + 1) * len(raw[order[n]]) <= most):
            n += 1
        yield order[at:n]
        at = n


def start(pieces: Pieces, langs: int) -> np.ndarray:
    """[piece, language]: probabilities before any training."""
    p = 0.05 ** pieces.lengths()
    return np.repeat((p / p.sum())[:, None], langs, axis=1)


def expected(pieces: Pieces, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """[piece, language]: how often each piece is expected in words that occur counts [word, language] times."""
    raw, seen = [spelled(w) for w in words], np.zeros(p.shape)
    for at in _chunks(raw, 1 << 16, 4 * SAMPLE_LETTERS + 1):
        lattice = Lattice(pieces, [raw[i] for i in at])
        alpha, beta = lattice.forward(p), lattice.backward(p)
        weight = counts[at] / np.maximum(beta[0], 1e-300)
        for end, n, rows, piece in lattice.found:
            np.add.at(seen, piece, alpha[end - n, rows] * p[piece] * _SCALE**n * beta[end, rows] * weight[rows])
    return seen


class Model:
    """Scores texts; keeps the scores of words it has met, up to a bound."""

    MOST = 200_000

    def __init__(self, pieces: Pieces, langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.langs)))

    def add(self, words: list[str]) -> None:
        if len(self.at) + len(words) > self.MOST:
            self.clear()
        n = len(self.at)
        while len(self.known) < n + len(words):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[n : n + len(words)] = word_scores(self.pieces, words, self.p)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior probability) of each text under equal priors; ('und', 0) without a letter."""
        found = [words_of(t) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        met = set().union(*found)
        new = sorted(met - self.at.keys())
        if new:
            if len(self.at) + len(new) > self.MOST:
                self.clear()
                new = sorted(met)
            self.add(new)
        out = []
        for ws in found:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.known[list(map(self.at.__getitem__, ws))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out(modulus: int = 4) -> Column:
    """crc32 of the id as text leaves 2; a null id is never held out, nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def train(labelled: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, every: bool = True) -> Model:
    """A model from rows with text and lang; unless every, rows that held_out() names are left out. About sample_docs documents of
    each language (chosen by a hash of the id) are learned from, with all their words of up to SAMPLE_LETTERS letters. Rows with
    null are skipped."""
    spark = labelled.sparkSession
    rows = pick(labelled, "doc_id", "text", "lang").filter("text is not null and lang is not null")
    rows = rows if every else rows.filter(~held_out())
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs, pieces = sorted(per), Pieces.load(vocabulary)
    p = start(pieces, len(langs))
    if not langs:
        return Model(pieces, langs, p)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(1.0, sample_docs / n))]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))

    def split(batches):
        for b in text_batches(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, n = np.unique(np.array([w for w in words_of(text) if len(w) <= SAMPLE_LETTERS], object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.string()), pa.array([langs.index(lang)] * len(words), pa.int32()), pa.array(n, pa.int64())], names=["word", "lang", "n"])

    words = chosen.select("text", "lang").mapInArrow(split, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = written(words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")), "langid-words")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((pieces, p))

        def expect(t):
            known, now = sent.value  # noqa: B023
            every_word = sorted(set(t["word"].to_pylist()))
            at = {w: i for i, w in enumerate(every_word)}
            counts = np.zeros((len(at), now.shape[1]))
            counts[[at[w] for w in t["word"].to_pylist()], t["lang"].to_numpy()] = t["n"].to_numpy()
            return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "seen": pa.array([expected(known, now, every_word, counts).tobytes()], pa.binary())})

        seen = np.full(p.shape, 0.05)
        for r in words.groupBy("bucket").applyInArrow(expect, "bucket int, seen binary").orderBy("bucket").toLocalIterator():
            seen += np.frombuffer(r[1]).reshape(p.shape)
        p = seen / seen.sum(axis=0)
        sent.destroy()
    drop_table(words)
    return Model(pieces, langs, p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score; nothing but the text decides.

    Null, empty or letterless text: 'und' with score 0, as are all texts if nothing could be learned. Texts of any length are
    scored whole. Repeated rows are judged alike; ties go to the language first in order; other columns are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.p))

    def run(batches):
        own = Model(*sent.value)
        for b in text_batches(batches):
            langs, scores = zip(*own.predict(b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a probability of at least least: letterless and null texts go, as do undecided ones."""
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.p))

    def keep():
        own = Model(*sent.value)
        return lambda texts: [lang != "und" and score >= least for lang, score in own.predict(texts)]

    return filtered(docs, keep)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, every=False)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": op1_langid}
