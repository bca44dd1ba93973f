"""Exact top-k search by inner product on a bit-sliced index.

Components become integers, floor(SCALE * x). Rows are put in blocks in order of their id; of each attribute of a block the index
keeps the least value and, for each binary digit of what is above it, a bitmap of the block's rows. A query's scores are sums of
attribute slices, each shifted by the digits of the query's own component: bitmaps of equal weight are added three at a time
(their parity stays, their majority is carried to the next weight), until one slice a weight is left. A negative component takes
the complements of the slices, so that everything added is positive, and a constant that all rows share puts the score right.

From the most significant score slice downward, rows with the digit set are taken as long as fewer than k have it; where more
have it, they are what is left to choose from. Rows still undecided after the last slice have equal scores; of them the smallest
ids fill up, exactly. What is left of each block meets at the query.

A query is compared with every row, as the search is asked to be exact: the work is queries times rows, in blocks. A task streams
the queries past one block at a time; packs of queries, not rows, are what is copied."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table, written
from .ranks import places

SCALE, K = 256, 5
BLOCK, PACK = 1 << 15, 64  # rows of a block, queries of a pack
INDEX = "block long, dim int, attribute int, low long, digits int, ids array<long>, slices binary"


# --- integers -------------------------------------------------------------------------------------------


def _integers(v: list | None, scale: int) -> np.ndarray | None:
    """The components as integers; None if the vector takes no part."""
    if not v or any(c is None for c in v):
        return None
    with np.errstate(over="ignore"):
        x = np.floor(np.array(v, np.float64) * scale)
    # by Cauchy and Schwarz two vectors below this length have an inner product of less than 2**62
    return x.astype(np.int32) if np.isfinite(x).all() and np.square(x).sum() < 2.0**62 else None


def quantised(df: DataFrame, id_column: str, scale: int = SCALE) -> DataFrame:
    """(id, dim, v): vectors as 32-bit integers, without those that take no part."""

    def run(batches):
        for b in batches:
            x = [_integers(v, scale) for v in b.column(1).to_pylist()]
            at = [i for i, v in enumerate(x) if v is not None]
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x[i]) for i in at], pa.int32()), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["id", "dim", "v"])

    rows = pick(df, id_column, "embedding").select(F.col(id_column).cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "id long, dim int, v binary")


# --- index ----------------------------------------------------------------------------------------------


def _digits(column: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(least value, number of digits, a bitmap of rows for each digit of what is above it, lowest first)."""
    low = int(column.min())
    above = (column.astype(np.int64) - low).astype(np.uint64)
    n = int(above.max()).bit_length()
    words = -(-len(column) // 64)
    out = np.zeros((n, words * 8), np.uint8)
    for k in range(n):
        packed = np.packbits((above >> np.uint64(k)).astype(np.uint8) & 1, bitorder="little")
        out[k, : len(packed)] = packed
    return low, n, out


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """INDEX: a row for each attribute of a block, and one (attribute -1) with the ids of its rows. rows: (id, dim, v).

    Ids ascend in a block, nulls last. A task holds one block: block * dim integers of 4 bytes."""

    def run(batches):
        key, ids, raw = None, [], []
        for b in batches:
            for now in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now[:2] != key:
                    yield from sliced(key, ids, raw)
                    key, ids, raw = now[:2], [], []
                ids.append(now[2])
                raw.append(now[3])
        yield from sliced(key, ids, raw)

    def sliced(key, ids, raw):
        if not ids:
            return
        m = np.frombuffer(b"".join(raw), np.int32).reshape(len(ids), -1)
        out = [(*key, -1, 0, 0, ids, b"")]
        for a in range(m.shape[1]):
            low, n, bits = _digits(np.ascontiguousarray(m[:, a]))
            out.append((*key, a, low, n, None, bits.tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "dim", "attribute", "low", "digits", "ids", "slices"])

    marked = rows.withColumn("row_", F.monotonically_increasing_id())
    placed = places(marked, F.col("dim"), F.col("id").asc_nulls_last(), F.col("row_"), name="slice-rows")
    placed = placed.withColumn("block", F.expr(f"position div {block}"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "block").sortWithinPartitions("block", "position").select("block", "dim", "id", "v").mapInArrow(run, INDEX)


# --- arithmetic -----------------------------------------------------------------------------------------


def add_slices(stacks: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """One slice a weight, lowest first, from any number of bitmaps (arrays of shape (n, words)) of each weight 2**w."""
    out, w = [], 0
    while w <= max(stacks, default=-1):
        parts = [p for p in stacks.pop(w, ()) if len(p)]
        carried = []
        rows = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else None
        while rows is not None and len(rows) > 1:
            n = len(rows) // 3
            if n:
                x, y, z = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                odd = x ^ y
                carried.append((x & y) | (odd & z))
                rows = np.concatenate([odd ^ z, rows[3 * n :]])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        if carried:
            stacks.setdefault(w + 1, []).extend(carried)
        out.append(rows[0] if rows is not None else None)
        w += 1
    return out


def _count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def top(scores: list[np.ndarray | None], allowed: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k largest sums among those allowed (all, if fewer), by slices from the most significant one downward;
    of rows that no slice tells apart, the first ones."""
    sure, left = np.zeros_like(allowed), allowed
    for s in reversed(scores):
        if s is None:
            continue
        have = left & s
        n = _count(sure | have)
        if n > k:
            left = have
        else:
            sure, left = sure | have, left & ~s
            if n == k:
                break
    chosen = _places(sure)
    return np.concatenate([chosen, _places(left)[: k - len(chosen)]]) if len(chosen) < k else chosen


class Block:
    """One block's slices, and their complements."""

    def __init__(self):
        self.ids, self.known, self.low, self.digits, self.slices = [], np.zeros(0, np.int64), {}, {}, {}

    def add(self, attribute: int, low: int, digits: int, ids: list | None, raw: bytes) -> None:
        if attribute < 0:
            self.ids = ids
            self.known = np.array([i for i in ids if i is not None], np.int64)
            return
        bits = np.frombuffer(raw, np.uint64).reshape(digits, -1) if digits else None
        self.low[attribute], self.digits[attribute] = low, digits
        self.slices[attribute] = (bits, ~bits) if digits else (None, None)

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """(id, score) of the best k rows but those with the query's own id."""
        stacks: dict[int, list[np.ndarray]] = {}
        base = 0
        for a, q in enumerate(query.tolist()):
            n = self.digits[a]
            base += q * self.low[a] - (-q * ((1 << n) - 1) if q < 0 else 0)
            bits, size, j = self.slices[a][q < 0], abs(q), 0
            while n and size:
                if size & 1:
                    for i in range(n):
                        stacks.setdefault(i + j, []).append(bits[i : i + 1])
                size, j = size >> 1, j + 1
        scores = add_slices(stacks)
        n = len(self.ids)
        allowed = np.zeros(-(-n // 64) * 64, np.uint8)
        allowed[:n] = 1
        allowed[np.searchsorted(self.known, own) : np.searchsorted(self.known, own, "right")] = 0
        found = top(scores, np.packbits(allowed, bitorder="little").view(np.uint64), k)
        total = [base] * len(found)
        for w, s in enumerate(scores):
            if s is not None:
                for x, bit in enumerate((s[found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)).tolist()):
                    total[x] += bit << w
        return [(self.ids[p], t) for p, t in zip(found.tolist(), total, strict=True)]


# --- search ---------------------------------------------------------------------------------------------


def _packed(queries: DataFrame) -> DataFrame:
    """(dim, first, ids, v): PACK queries of equal length or fewer; first tells packs apart."""

    def run(batches):
        for b in batches:
            number, ids, dims, vs = (c.to_pylist() for c in b.columns)
            for d in sorted(set(dims)):
                at = [i for i, x in enumerate(dims) if x == d]
                for i in range(0, len(at), PACK):
                    few = at[i : i + PACK]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([number[few[0]]], pa.int64()), pa.array([[ids[x] for x in few]], pa.list_(pa.int64())), pa.array([b"".join(vs[x] for x in few)], pa.binary())], names=["dim", "first", "ids", "v"])

    return queries.select(F.monotonically_increasing_id(), "id", "dim", "v").mapInArrow(run, "dim int, first long, ids array<long>, v binary")


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, score): for each of queries (id, dim, v), the k best rows of the index, but those with its own id.

    Ties go to the smaller id, null last. Vectors of different length do not meet. index and queries are tables. Queries that
    repeat an id are answered one by one."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    lanes = max(1, parts // blocks)  # where blocks are few, several tasks hold the same block, each with a share of the packs
    none = lambda t: F.lit(None).cast(t)
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    left = index.select("block", lane.alias("lane"), F.lit(0).alias("kind"), "dim", F.col("attribute").cast("long").alias("at"), "low", "digits", "ids", F.col("slices").alias("raw"))
    packs = written(_packed(queries), "slice-packs", free=False)
    right = packs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("first"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), "dim", F.col("first").alias("at"), none("long").alias("low"), none("int").alias("digits"), "ids", F.col("v").alias("raw"))

    def run(batches):
        key, held = None, {}
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            out = []
            for block, lane, kind, dim, at, low, digits, ids, raw in zip(*rows, strict=True):
                if (block, lane) != key:
                    key, held = (block, lane), {}
                if kind == 0:
                    held.setdefault(dim, Block()).add(at, low, digits, ids, raw)
                elif dim in held:
                    for n, (own, q) in enumerate(zip(ids, np.frombuffer(raw, np.int32).reshape(len(ids), dim), strict=True)):
                        out += [(at, n, own, *found) for found in held[dim].search(own, q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["pack", "n", "query_id", "id", "score"])

    met = left.unionByName(right).repartition(parts, "block", "lane").sortWithinPartitions("block", "lane", "kind", "dim", "at")
    best = met.mapInArrow(run, "pack long, n int, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("pack", "n").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_vectors(embeddings: DataFrame, every: int = 50, k: int = K, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """Per vector whose vec_id is divisible by every: query_id, rank (from 1), vec_id, score of its k best other vectors (all, if fewer).

    Null and empty vectors and those with null or non-finite components take no part, nor do those whose integers have a squared
    length of 2**62 or more, whose scores need not fit a long. Vectors of different length do not meet. Rows that share the query's
    vec_id are not its candidates; other repeated rows count each. Null ids are candidates, last among ties, and never queries.
    Other columns are not looked at; an empty table gives an empty result."""
    rows = written(quantised(embeddings, "vec_id", scale), "slice-vectors", free=False)
    index = written(build_index(rows, block), "slice-index", free=False)
    return search(index, rows.filter(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


def op12_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op12_slices": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
}
QUERIES = {"op12_slices": op12_slices}
