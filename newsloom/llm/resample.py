"""Target-distribution importance resampling.

Runs of one and two words are counted by bucket of their crc32, over all documents and over the target texts. A bucket's gain is
the scaled logarithm of how much more frequent it is in the target; a document's weight is the mean gain of its runs, and its
score the weight plus Gumbel noise drawn from a hash of its id, so that the highest scores are a sample without replacement.

The k-th highest score is found by radix selection on the digits of the composite key (score downward, then doc_id): a histogram
of one digit at a time, among the rows that agree in the digits before, which are bounded tables whatever the input. Only rows up
to that key are sorted, by ranges, and ranked."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_batches, written
from .ranks import places

BUCKETS, SCALE, SHARE, LEAST_WORDS, DIGIT = 10_000, 1000, 25, 20, 12
SEED = 7
PIECE = 1 << 20  # bytes of text that are taken apart at once
_TO = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_SHORT, _NEAR = 24, 64  # bytes of a word whose crc32 is reckoned for many at once; of one that a run is continued with likewise


# --- crc32 of words and runs ----------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()


def _behind() -> np.ndarray:
    """For each number of bytes up to _NEAR, what each byte of a crc32 becomes when so many zero bytes follow: (bytes, 4, 256)."""
    out = np.zeros((_NEAR + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _NEAR + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _BYTE[out[n - 1] & 255]
    return out


_BEHIND = _behind()


def word_crcs(a: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each word of a."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    at = at[np.searchsorted(-np.minimum(sizes, _SHORT + 1)[at], -_SHORT) :]  # short words, longest first
    s, n = starts[at], sizes[at]
    c = out[at]
    for j in range(int(n[0]) if len(n) else 0):
        m = np.searchsorted(-n, -j)  # words of more than j bytes
        c[:m] = (c[:m] >> np.uint32(8)) ^ _BYTE[(c[:m] ^ a[s[:m] + j]) & 255]
    out[at] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = zlib.crc32(a[starts[i] : starts[i] + sizes[i]])
    return out


def pair_crcs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each left word, a space and right word, from the words' own: the left one's is carried on over the bytes that follow."""
    spaced = (_BYTE[(left ^ np.uint32(0xFFFFFFFF) ^ 32) & 255] ^ ((left ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    n = np.minimum(sizes, _NEAR)
    out = right.copy()
    for k in range(4):
        out ^= _BEHIND[n, k, (spaced >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(sizes > _NEAR).tolist():
        out[i] = zlib.crc32(a[starts[i] : starts[i] + sizes[i]], int(spaced[i]))
    return out


def _pieces(text: bytes, most: int):
    """(bytes, words told before): a text in pieces of about most bytes, cut behind words; each begins with the last word before it."""
    a, at, last = np.frombuffer(text, np.uint8), 0, np.zeros(0, np.uint8)
    while at < len(a):
        end = min(at + most, len(a))
        while end < len(a):
            gap = np.flatnonzero(_TO[a[end : end + most]] == 32)
            end += int(gap[0]) if len(gap) else min(most, len(a) - end)
            if len(gap):
                break
        piece = _TO[a[at:end]]
        yield np.concatenate([last, [np.uint8(32)], piece]), int(len(last) > 0)
        letters = np.flatnonzero(piece != 32)
        if len(letters):
            gap = np.flatnonzero(piece[: letters[-1]] == 32)
            last = piece[gap[-1] + 1 if len(gap) else 0 : letters[-1] + 1]
        at = end


def runs_of(texts: list[str | None], most: int = PIECE):
    """(first, words, owner, crc), for some texts at a time: the first one's index, the number of words of each, and of each run of one
    or two words its text (counted from first) and its crc32. A text of more than most bytes comes in pieces, one at a time."""
    group, size = [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) > most:
            if group:
                yield _runs(i - len(group), group, [0] * len(group))
                group, size = [], 0
            for piece, told in _pieces(raw, most):
                yield _runs(i, [piece], [told])
            continue
        group.append(_TO[np.frombuffer(raw, np.uint8)])
        size += len(raw)
        if size > most:
            yield _runs(i + 1 - len(group), group, [0] * len(group))
            group, size = [], 0
    if group:
        yield _runs(len(texts) - len(group), group, [0] * len(group))


def _runs(first: int, group: list[np.ndarray], told: list[int]):
    gap = np.full(1, 32, np.uint8)
    a = np.concatenate([gap, *[x for g in group for x in (g, gap)]])
    space = a == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    begins = np.cumsum([1] + [len(g) + 1 for g in group])
    ptr = np.searchsorted(starts, begins)
    words = np.diff(ptr) - np.array(told)
    text = np.repeat(np.arange(len(group)), np.diff(ptr))
    crc = word_crcs(a, starts, sizes)
    together = text[1:] == text[:-1]
    pairs = pair_crcs(crc[:-1], crc[1:], sizes[1:], a, starts[1:])[together] if len(crc) > 1 else np.zeros(0, np.uint32)
    new = int(any(told))  # of a piece that goes on, the first word was told before; the run that it begins was not
    return first, words, np.concatenate([text[new:], text[1:][together]]), np.concatenate([crc[new:], pairs])


# --- counts, gains, weights -----------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): runs of each bucket over all texts. A task sends a row a bucket at most."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in text_batches(batches):
            for _, _, _, crc in runs_of(b.column(0).to_pylist()):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    return pick(docs, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The gain of each bucket, from its runs among documents and in the target."""
    size = len(documents)
    s, t, all_s, all_t = documents + 1.0, target + 1.0, float(documents.sum() + size), float(target.sum() + size)
    return np.array([math.floor(scale * math.log(x * all_s / (y * all_t))) for x, y in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight) per row of docs (doc_id, text). The gains are a number a bucket, sent to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = sent.value
        for b in text_batches(batches):
            n = b.num_rows
            words, runs, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for first, w, owner, crc in runs_of(b.column(1).to_pylist()):
                end = first + len(w)
                words[first:end] += w
                runs[first:end] += np.bincount(owner, minlength=len(w))
                # sums of integers below 2**53 are exact in doubles
                total[first:end] += np.bincount(owner, g[crc % np.uint32(len(g))], minlength=len(w)).astype(np.int64)
            weight = np.where(runs > 0, total // np.maximum(runs, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(runs), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def noise(seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from the hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# --- selection ------------------------------------------------------------------------------------------


def kth(rows: DataFrame, keys: list[str], k: int, digit: int = DIGIT) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) of the composite key of long columns, none null; None if there are not so many rows.

    A pass for each digit of digit bits of what is above a column's least value; the driver sees 2**digit counts of a pass."""
    ends = rows.agg(F.count("*").alias("n"), *[f(x).alias(f"{m}{i}") for i, x in enumerate(keys) for m, f in (("low", F.min), ("high", F.max))]).first()
    if not 0 < k <= ends["n"]:
        return None
    out: list[int] = []
    for i, x in enumerate(keys):
        low, bits = ends[f"low{i}"], int(ends[f"high{i}"] - ends[f"low{i}"]).bit_length()
        above, prefix = F.col(x) - F.lit(low), 0
        if bits > 63:  # the column spans all longs: its difference wraps, so digits are taken of the value with its sign turned
            low, bits, above = -(1 << 63), 64, F.col(x).bitwiseXOR(F.lit(-(1 << 63)))
        for shift in range(max(0, -(-bits // digit) - 1) * digit, -1, -digit):
            found = rows.groupBy(F.shiftrightunsigned(above, shift).bitwiseAND(F.lit((1 << digit) - 1)).alias("d")).agg(F.count("*").alias("n")).collect()
            for d, n in sorted((r.d, r.n) for r in found):
                if k <= n:
                    break
                k -= n
            prefix = prefix << digit | d
            rows = rows.filter(F.shiftrightunsigned(above, shift).bitwiseAND(F.lit((1 << digit) - 1)) == d)
        out.append(low + prefix)
    return tuple(out)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (1, 2, ... of the rows drawn, else null).

    share in a hundred of the rows with at least least_words words are drawn, by score, ties to the smaller doc_id, then to fewer
    runs. Null text has no words. A null id has the noise of an empty one and comes last among ties. Rows that repeat an id and a
    text are drawn one by one. Other columns are not looked at. Empty tables: nothing is drawn, or all gains are those of no target."""
    seen, wanted = (np.zeros(buckets, np.int64) for _ in range(2))
    for into, df in ((seen, docs), (wanted, target)):
        for r in bucket_counts(df, buckets).collect():  # a row a bucket
            into[r.bucket] = r.n
    own = weighed(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), gains(seen, wanted))
    rows = written(own.withColumn("score", F.col("weight") + noise(seed)), "resample-rows", free=False)
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    keyed = rows.withColumn("down", -F.col("score")).withColumn("id", last).withColumn("null_id", F.col("doc_id").isNull().cast("long"))
    fit = keyed.filter(F.col("words") >= least_words)
    k = fit.count() * share // 100
    keys = ["down", "id", "null_id", "n_features"]
    edge = kth(fit, keys, k)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return rows.select(*out, none)
    at, to = F.struct(*[F.col(x) for x in keys]), F.struct(*[F.lit(x).cast("long").alias(y) for x, y in zip(edge, keys, strict=True)])
    upto = (F.col("words") >= least_words) & (at <= to)
    drawn = places(keyed.filter(upto).withColumn("row_", F.monotonically_increasing_id()), *[F.col(x) for x in keys], F.col("row_"), name="resample-drawn")
    rank = F.col("position") + 1  # rows alike in the whole key may stand beyond the k-th place
    return drawn.select(*out, F.when(rank <= k, rank).cast("long").alias("rank")).unionByName(keyed.filter(~upto).select(*out, none))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    # crc32 is reckoned four bits at a time, once for each different run
    "op13_resample": r"""WITH nibble AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(16))::BIGINT AS i))),
    texts AS (SELECT true AS mine, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
    split AS (SELECT mine, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    runs AS (SELECT mine, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
    grouped AS (SELECT mine, row, f, count(*) AS n FROM runs GROUP BY ALL),
    coded AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grouped)),
    bucketed AS (SELECT f, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h)), lambda i: (strpos('0123456789ABCDEF', substr(h, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)) - 1)::BIGINT)),
        lambda c, x: xor(c >> 4, t[1 + xor(c & 15, x)]))) % 10000 AS bucket FROM coded, nibble),
    placed AS (SELECT mine, row, bucket, n FROM grouped JOIN bucketed USING (f)),
    total AS (SELECT bucket, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM placed GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM total) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM total) + 10000)::DOUBLE))) AS g FROM total),
    summed AS (SELECT row, sum(n) AS n_features, floor(sum(n * g) / sum(n)) AS weight FROM placed JOIN gain USING (bucket) WHERE mine GROUP BY row),
    scored AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM split LEFT JOIN summed USING (row) WHERE mine),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM scored WHERE words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
}
QUERIES = {"op13_resample": op13_resample}
