"""Embedding near-dedup by collision-counting projections.

Vectors of length 1 are projected on many random lines. Two vectors collide on a line if one lies in the window centred on
the other; of a pair with cosine 0.9 the number of collisions is binomial, so the count a pair must reach is its RECALL
quantile. Pairs that reach it are verified in double precision.

One line alone leaves a third of all vectors in a window, so pairs are looked for in cells: in each of some tables, CELL
lines are cut into intervals at random offsets, and vectors of one cell are compared. More vectors take more lines a cell
and more tables; both follow from the number of vectors, the probability of sharing a cell and RECALL. Equal vectors are one
point with a weight. Cells of over BLOCK points are dealt out as pairs of blocks, and what leaves a task is, for each
point, its number of links and one link of a spanning forest: never the pairs. A pair counts in the first table in which
it shares a cell. A cell larger than any bound is still compared in full."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written
from .components import components

COSINE, RECALL, SEED = 0.9, 0.98, 20240131
LINES, HALF_WINDOW = 24, 0.6
CELL_WIDTH, CELL_POINTS, BLOCK = 2.0, 1000, 4096


def _spread(cosine: float) -> NormalDist:
    """Of the difference of two unit vectors' projections on a random Gaussian line."""
    return NormalDist(0, math.sqrt(2 - 2 * cosine))


def least_collisions(cosine: float = COSINE, recall: float = RECALL, lines: int = LINES, half: float = HALF_WINDOW) -> int:
    """The largest count that a pair of this cosine reaches with probability recall or more."""
    d = _spread(cosine)
    p = d.cdf(half) - d.cdf(-half)
    total = 0.0
    for count in range(lines, -1, -1):
        total += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if total >= 1 - (1 - recall) / 4:
            return count
    return 0


def _same_cell(cosine: float, width: float = CELL_WIDTH) -> float:
    d, step = _spread(cosine), width / 500
    return sum(d.pdf((i + 0.5) * step) * step * 2 * (1 - (i + 0.5) / 500) for i in range(500))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, points: int = CELL_POINTS) -> tuple[int, int]:
    """(lines a cell, tables) for n vectors: cells of about points unrelated vectors, and tables for the recall of a pair at the threshold."""
    near, far = _same_cell(cosine), _same_cell(0.0)
    lines = max(0, round(math.log(max(1, n / points)) / -math.log(far)))
    return (lines, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**lines)))) if lines else (0, 1)


def _unit(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _scaled(v: list | None) -> np.ndarray | None:
    """The vector in double precision, its largest component 1 in size; None if it links with nothing."""
    if not v or any(c is None for c in v):
        return None
    x = np.array(v, np.float64)
    most = np.abs(x).max()
    return x / most if np.isfinite(x).all() and most > 0 else None


def _read(batches):
    for b in batches:
        node, raw = [], []
        for v in b.column(1).to_pylist():
            x = _scaled(v)
            raw.append(None if x is None else x.tobytes())
            node.append(None if x is None else int.from_bytes(hashlib.blake2b(raw[-1], digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "node", "x"])


def _cells(points: DataFrame, lines: int, tables: int) -> DataFrame:
    """A row for each point and table: t, cell, node, weight, x, and the cells of all tables."""

    def run(batches):
        for b in batches:
            xs, nodes, weights = (b.column(i).to_pylist() for i in (2, 0, 1))
            for dim in sorted({len(x) for x in xs}):
                at = [i for i, x in enumerate(xs) if len(x) == dim]
                unit = _unit(b"".join(xs[i] for i in at), len(at))
                rng = np.random.default_rng(SEED + dim)
                keys = np.zeros((len(at), tables), np.int64)
                for t in range(tables):
                    cut = np.floor((unit @ rng.standard_normal((dim // 8, lines)) + rng.uniform(0, CELL_WIDTH, lines)) / CELL_WIDTH).astype(np.int64)
                    keys[:, t] = [int.from_bytes(hashlib.blake2b(r.tobytes() + bytes([dim % 251]), digest_size=8).digest(), "little", signed=True) for r in cut]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(keys[:, t]), pa.array([nodes[i] for i in at], pa.int64()), pa.array([weights[i] for i in at], pa.int64()), pa.array([xs[i] for i in at], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                        names=["t", "cell", "node", "weight", "x", "cells"],
                    )

    return points.select("node", "weight", "x").mapInArrow(run, "t int, cell long, node long, weight long, x binary, cells binary")


def join_block(nodes, weights, unit, cells, side, t: int, lines: np.ndarray, least: int, cosine: float = COSINE, chunk: int = 128):
    """(links of each point, forest): side tells the blocks of two apart; with one block all pairs are compared."""
    s = len(nodes)
    place = (unit @ lines).astype(np.float32)
    links, root = np.zeros(s, np.int64), np.arange(s)
    two = len(set(side.tolist())) > 1
    rows = np.flatnonzero(side == side.min()) if two else np.arange(s)
    other = np.flatnonzero(side != side.min()) if two else None
    for k in range(0, len(rows), chunk):
        i = rows[k : k + chunk]
        j = other if two else np.arange(i[0] + 1, s)
        if not len(j):
            continue
        count = np.zeros((len(i), len(j)), np.uint8)
        for line in range(place.shape[1]):
            count += np.abs(place[i, line][:, None] - place[j, line][None, :]) <= HALF_WINDOW
        a, b = np.nonzero(count >= least)
        if not two:
            keep = j[b] > i[a]
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        x, y = i[a], j[b]
        ok = np.concatenate([np.einsum("ij,ij->i", unit[x[q : q + 65536]], unit[y[q : q + 65536]]) for q in range(0, len(x), 65536)]) >= cosine
        x, y = x[ok], y[ok]
        for earlier in range(t):
            new = cells[x, earlier] != cells[y, earlier]
            x, y = x[new], y[new]
        links += np.bincount(x, weights[y], s).astype(np.int64) + np.bincount(y, weights[x], s).astype(np.int64)
        while len(x):
            low = np.minimum(root[x], root[y])
            if (low == root[x]).all() and (low == root[y]).all():
                break
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while (root[root] != root).any():
                root = root[root]
    return links, root


def _joined(blocks: DataFrame, tables: int, least: int) -> DataFrame:
    """(node, links, root) from rows of blocks, one group (t, cell, low, high) after the other."""

    def group(key, rows):
        t, _, low, high = key
        mine = list(zip(*rows, strict=True))
        unit = _unit(b"".join(mine[2]), len(rows))
        cells = np.frombuffer(b"".join(mine[3]), np.int64).reshape(len(rows), tables)
        lines = np.random.default_rng(SEED - 1 - unit.shape[1]).standard_normal((unit.shape[1], LINES))
        nodes = np.array(mine[0], np.int64)
        links, root = join_block(nodes, np.array(mine[1], np.int64), unit, cells, np.array(mine[4]), t, lines, least)
        at = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at]), pa.array(nodes[root[at]])], names=["node", "links", "root"])

    def run(batches):
        last, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:4] != last:
                    if len(rows) > 1:
                        yield from group(last, rows)
                    last, rows = row[:4], []
                rows.append(row[4:])
        if len(rows) > 1:
            yield from group(last, rows)

    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.select("t", "cell", "low", "high", "node", "weight", "x", "cells", "block").repartition(parts, "t", "cell", "low", "high").sortWithinPartitions("t", "cell", "low", "high", "node").mapInArrow(run, "node long, links long, root long")


def link_vectors(embeddings: DataFrame) -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, as do vectors of different
    length. Equal vectors always link, rows that share an id among them. Rows with a null id count as links of others, but
    name no component unless all its ids are null. Other columns are not looked at; an empty table gives an empty result."""
    rows = written(pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_read, "vec_id long, node long, x binary"), "vector-rows")
    points = written(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.first("x").alias("x"), F.min("vec_id").alias("low")), "vector-points")
    lines, tables = plan(points.count())
    cells = written(_cells(points, lines, tables), "vector-cells")
    size = cells.groupBy("t", "cell").count().filter("count > 1")
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = cells.join(size, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    found = written(_joined(dealt, tables, least_collisions()), "vector-links")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.filter("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = points.join(comp, F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = rows.select("vec_id", "node").join(named.select("node", "weight", "component").join(lowest, "component").join(total, "node", "left"), "node", "left")
    links = F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_vectors": op4_vectors}
