"""N-gram Jaccard join over count vectors in R-trees.

A document is a set of word shingles. Its shingles are hashed into groups, and the counts of the groups are a point: the
sum of the coordinate minima of two points bounds the overlap of the sets from above, and so do the corners of the boxes
of an R-tree. Pairs that survive are verified on the sets themselves.

A tree over all documents would be scanned whole for each query, since counts of hashed groups hardly differ in any one
coordinate. So a document goes only to the trees of the shingles in its prefix: the n/5 + 1 smallest hashes, of which two
sets of similarity 0.8 share at least one. Equal sets are one point. Groups of similar documents are first linked to the
smallest id of their trees, a pair a document; then only points that are not yet connected are searched for each other.
No link between components is lost, and no group of similar documents is expanded into its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import carried, mix, pick, restored, table, text_batches, window_hashes, word_hashes, written
from .components import components

SHINGLE, GROUPS, COARSE, LEAF = 5, 512, 64, 64
BLOCK = 8192  # points of one shingle's tree; more are dealt out as pairs of blocks


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, a text without words none."""
    words, ptr, *_ = word_hashes(texts, lower=True)
    out = []
    for i in range(len(texts)):
        w = words[ptr[i] : ptr[i + 1]]
        out.append(np.unique(window_hashes(w, n)) if len(w) >= n else np.unique(mix(window_hashes(w, len(w)) + np.uint64(len(w)))) if len(w) else w)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def pack(shingles: np.ndarray) -> bytes:
    """The counts of the groups; a byte each where that holds them, else four."""
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32).tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    narrow = all(len(p) == GROUPS for p in packed)
    return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), GROUPS) if narrow else np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.int32).astype(np.int32) for p in packed])


def may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of rows of points and sizes: an overlap of 4/9 of both sizes (similarity 0.8) is within the bound."""
    return 9 * np.minimum(a, b).sum(axis=1, dtype=np.int64) >= 4 * (n + m)


class RTree:
    """A packed tree over points sorted by size: leaves of LEAF points, nodes of LEAF leaves; boxes keep the upper corners.

    Boxes and the first bound sum groups to COARSE ones, which bounds more loosely but faster."""

    def __init__(self, fine: np.ndarray, sizes: np.ndarray):
        self.fine = fine
        self.points, self.sizes = fine.reshape(len(fine), COARSE, -1).sum(axis=2, dtype=np.int32), sizes
        points = self.points
        self.starts = np.arange(0, len(points), LEAF)
        self.upper = np.maximum.reduceat(points, self.starts, axis=0)
        self.low, self.high = np.minimum.reduceat(sizes, self.starts), np.maximum.reduceat(sizes, self.starts)
        self.nodes = np.arange(0, len(self.starts), LEAF)
        self.node_upper, self.node_low, self.node_high = np.maximum.reduceat(self.upper, self.nodes, axis=0), np.minimum.reduceat(self.low, self.nodes), np.maximum.reduceat(self.high, self.nodes)

    def pairs(self):
        """Arrays (i, j), i < j, of all pairs of points that may have similarity 0.8, a leaf of queries at a time."""
        for q, start in enumerate(self.starts):
            box, low, high = self.upper[q], self.low[q], self.high[q]
            node = np.flatnonzero((5 * self.node_high >= 4 * low) & (5 * high >= 4 * self.node_low) & (9 * np.minimum(self.node_upper, box).sum(axis=1) >= 4 * (self.node_low + low)))
            for x in node:
                a, b = self.nodes[x], min(self.nodes[x] + LEAF, len(self.starts))
                leaf = a + np.flatnonzero((5 * self.high[a:b] >= 4 * low) & (5 * high >= 4 * self.low[a:b]) & (9 * np.minimum(self.upper[a:b], box).sum(axis=1) >= 4 * (self.low[a:b] + low)))
                mine, n = self.points[start : start + LEAF], self.sizes[start : start + LEAF]
                for y in leaf[leaf >= q]:
                    at = self.starts[y]
                    other, m = self.points[at : at + LEAF], self.sizes[at : at + LEAF]
                    bound = np.minimum(mine[:, None, :], other[None, :, :]).sum(axis=2)
                    i, j = np.nonzero(9 * bound >= 4 * (n[:, None] + m[None, :]))
                    i, j = i + start, j + at
                    keep = i < j
                    i, j = i[keep], j[keep]
                    keep = may_be_similar(self.fine[i], self.fine[j], self.sizes[i], self.sizes[j])
                    if keep.any():
                        yield i[keep], j[keep]


def _points(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n, k1, k2 (hashes of the whole set), prefix, counts."""

    def run(batches):
        for b in text_batches(batches):
            sets = shingle_sets(b.column(1).to_pylist())
            prefix = [s[: len(s) // 5 + 1] for s in sets]
            counts = [pack(s) for s in sets]
            k1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            k2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            values = np.concatenate(prefix).astype(np.int64) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(counts, pa.binary())],
                names=["doc_id", "mark", "n", "k1", "k2", "prefix", "counts"],
            )

    return docs.mapInArrow(run, "doc_id long, mark long, n long, k1 long, k2 long, prefix array<long>, counts binary")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that the counts of groups leave."""
    side = lambda x: points.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "counts_a", "counts_b")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                n, m = (np.asarray(b.column(i)) for i in (2, 3))
                ok = pa.array(may_be_similar(unpack(b.column(4).to_pylist()), unpack(b.column(5).to_pylist()), n, m))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of points whose sets are similar. Only the texts of these pairs are moved."""
    pairs = written(pairs, "jaccard-pairs")
    ids = pairs.select(F.col("a").alias("point")).union(pairs.select(F.col("b").alias("point"))).distinct()
    named = classes.select("point", F.col("representative").alias("doc_id"), "mark").join(ids, "point", "left_semi")
    texts = written(docs.join(named, ["doc_id", "mark"]).select("point", "text"), "jaccard-texts")
    side = lambda x: texts.select(F.col("point").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for b in text_batches(batches, text="text_a"):
            left, right = shingle_sets(b.column(2).to_pylist()), shingle_sets(b.column(3).to_pylist())
            ok = pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _search(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (h, blocks, doc_id, component, n, counts) of one h that lie in different components and may be similar.

    The rows of a frequent h, of so many blocks, go to a task for each pair of blocks; blocks is null where one is enough."""
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("long")
    dealt = rows.withColumn("with", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    low, high = F.least(block, F.col("with")), F.greatest(block, F.col("with"))
    deal = F.when(F.col("blocks").isNotNull(), F.shiftleft(low, 40) + F.shiftleft(high, 20) + block)
    dealt = dealt.select(F.when(F.col("blocks").isNull(), F.col("h")).otherwise(F.xxhash64("h", low, high)).alias("g"), deal.alias("deal"), "doc_id", "component", "n", "counts")

    def group(rows: list[tuple]):
        ids, comp, sizes = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        block, two = np.array([(r[0] or 0) & 0xFFFFF for r in rows]), rows[0][0] is not None and rows[0][0] >> 40 != rows[0][0] >> 20 & 0xFFFFF
        for i, j in RTree(unpack([r[4] for r in rows]), sizes).pairs():
            other = comp[i] != comp[j]
            other &= (block[i] != block[j]) | (not two)
            a, b = ids[i[other]], ids[j[other]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        last, rows = None, []
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != last:
                    if len(rows) > 1:
                        yield from group(rows)
                    last, rows = g, []
                rows.append(row)
        if len(rows) > 1:
            yield from group(rows)

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "g").sortWithinPartitions("g", "n", "doc_id").mapInArrow(run, "a long, b long")


def _classes(real: DataFrame) -> DataFrame:
    """(k1, k2, n, representative, mark, point): a row for each set, with the smallest row that has it and its point.

    The point is the representative's id, or a hash of the set where several sets have the same representative."""
    first = real.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    plain = written(first.select("k1", "k2", "n", F.col("first.doc_id").alias("representative"), F.col("first.mark").alias("mark")), "jaccard-sets")
    several = plain.groupBy("representative").count().filter("count > 1").select("representative", F.lit(True).alias("several"))
    point = F.when(F.col("several"), F.xxhash64("k1", "k2", "n", "representative")).otherwise(F.col("representative"))
    return plain.join(several, "representative", "left").select("k1", "k2", "n", "representative", "mark", point.alias("point"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, mark (a hash of the text), n_shingles, representative (smallest id with the same set), component_id,
    kept (whether id and text are the smallest of the component).

    Null, empty or blank text: no shingles, linked with nothing, kept. Rows with a null id are linked with nothing, kept, and get a null
    component. Equal texts, repeated rows among them, are linked; rows that share an id but not their text are judged each by
    its text. Other columns are not looked at; an empty table gives an empty result."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    points = written(_points(docs), "jaccard-points")
    real = points.filter("n > 0 and doc_id is not null")
    classes = written(_classes(real), "jaccard-classes")
    copies = real.join(classes.drop("mark", "point"), ["k1", "k2", "n"]).filter("doc_id <> representative").select("doc_id", "k1", "k2", "n").distinct()
    own = real.join(copies, ["doc_id", "k1", "k2", "n"], "left_anti")
    other = written(classes.filter("point <> representative").select("k1", "k2", "n", "point"), "jaccard-renamed")  # none where ids do not repeat
    own = own.join(other, ["k1", "k2", "n"], "left").select(F.coalesce("point", "doc_id").alias("doc_id"), "n", "prefix", "counts")
    same = Window.partitionBy("h")
    trees = own.select(F.explode("prefix").alias("h"), "doc_id", "n").withColumns({"low": F.min("doc_id").over(same), "high": F.max("doc_id").over(same)}).filter("low < high").select("h", "doc_id", "n", "low")
    trees = written(trees, "jaccard-trees")

    # first a pair a document: with the smallest id that most of its trees have
    leader = trees.filter("doc_id <> low").groupBy("doc_id", "low").count().groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("low")).alias("low"))).alias("best"))
    leader = leader.select((-F.col("best.low")).alias("a"), F.col("doc_id").alias("b"))
    first = written(_verified(_bounded(leader, own), docs, classes), "jaccard-links")
    comp = written(components(first), "jaccard-components")

    # then all pairs of points in different components
    placed = trees.select("h", "doc_id", "n").join(comp, F.col("doc_id") == F.col("id"), "left").select("h", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    by_size = same.orderBy("n", "doc_id")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole), "m": F.count("*").over(whole), "less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    # a point whose neighbours in order of size are both too small or large has no similar point in this tree
    fits = (5 * F.coalesce("less", F.lit(0)) >= 4 * F.col("n")) | (4 * F.col("more") <= 5 * F.col("n"))
    split = written(placed.filter("low < high").filter(fits).select("h", F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / BLOCK)).alias("blocks"), "doc_id", "component"), "jaccard-split")
    near = _search(split.join(own.select("doc_id", "n", "counts"), "doc_id")).distinct()
    second = _verified(near, docs, classes)
    links = first.union(second)
    final = written(components(links), "jaccard-final")
    least = final.join(classes, F.col("id") == F.col("point")).groupBy("component").agg(F.min(F.struct("representative", "mark")).alias("least"))
    final = final.join(least, "component").select("id", "least")
    mine = classes.select("k1", "k2", "n", "representative", "point", F.struct("representative", "mark").alias("own"))
    out = points.select("doc_id", F.col("mark").alias("m"), "n", "k1", "k2").join(mine, ["k1", "k2", "n"], "left").join(final, F.col("point") == F.col("id"), "left")
    out = out.withColumn("least", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "own")))
    kept = F.coalesce((F.col("doc_id") == F.col("least.representative")) & (F.col("m") == F.col("least.mark")), F.lit(True))
    return out.select(
        "doc_id", F.col("m").alias("mark"), F.col("n").alias("n_shingles"), F.coalesce("representative", "doc_id").alias("representative"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least.representative", "doc_id")).alias("component_id"), kept.alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that are linked, directly or not, to a smaller id or to a smaller text of their id.

    Rows with a null id, and texts without words, stay. Of rows that repeat id and text the smallest by its other columns stays.
    An empty table gives an empty one; names may clash."""
    gone = written(jaccard_components(docs).filter("not kept").select(F.col("doc_id").alias("gone"), F.col("mark").alias("lost")).distinct(), "jaccard-gone")
    rows = carried(docs, "doc_id", "text").select("rest", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    out = rows.join(gone, (F.col("doc_id") == F.col("gone")) & (F.col("mark") == F.col("lost")), "left_anti")
    if rows.filter("doc_id is not null").groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        return restored(out, docs)
    number = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.to_json("rest")))
    return restored(out.withColumn("n", number).filter("doc_id is null or n = 1"), docs)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_jaccard": op10_jaccard}
