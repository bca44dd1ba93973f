"""Multidimensional clustered layout with a bitmap index.

Each dimension is cut at its quantiles into a few coordinates; rows are ordered by the interleaved binary digits of their
coordinates and cut into files of equally many rows. The index has, for each coordinate of each dimension, a bitset of the files
whose bounds cover it. A query is a coordinate of each dimension and a reach; its files are found by OR of the bitsets within
reach, AND across dimensions, and popcount. Second bitmaps, of the files that hold a row of a cell, tell which files match.

Bitsets come in words of 64 files, each a row, so that they grow by rows and not by width: a billion files are 16 million words,
which are joined to nothing, sent nowhere whole and read by any number of tasks. What is sent whole to the tasks are the counts of
all cells, at most buckets ** dimensions rows (BROADCAST_CELLS), and what comes to the driver is the smallest value of each
coordinate (buckets rows a dimension)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table, written
from .ranks import places, sums_before

BUCKETS, ROWS, WORD = 8, 1000, 64
#: Up to so many cells (some 60 bytes each) the table of their counts is broadcast; beyond, it is joined by shuffle.
BROADCAST_CELLS = 1 << 16


# --- coordinates ----------------------------------------------------------------------------------------


def edges(rows: DataFrame, names: list[str], buckets: int = BUCKETS) -> list[list[tuple[int, object]]]:
    """For each column, (coordinate, smallest value that has it), ascending. Values are counted before anything is sorted, so a
    value's rows are one row here; strings compare by bytes, null is smallest. An empty table has no edges."""
    text = {x: dict(rows.dtypes)[x] == "string" for x in names}
    one = [F.struct(F.lit(i).alias("dim"), (F.col(x) if text[x] else F.lit(None)).cast("string").alias("s"), (F.lit(None) if text[x] else F.col(x)).cast("long").alias("v")) for i, x in enumerate(names)]
    counts = rows.select(F.explode(F.array(*one)).alias("x")).groupBy("x.dim", "x.s", "x.v").agg(F.count("*").alias("n"))
    before = sums_before(counts, "n", "dim", "s", "v", name="layout-values")
    total = rows.count()  # each dimension has every row once, so the sums of the dimensions before are told by it
    if not total:
        return [[] for _ in names]
    at = F.expr(f"({buckets} * (before - dim * {total}L)) div {total}L").cast("int")
    least = before.groupBy("dim", at.alias("c")).agg(F.min(F.struct("s", "v")).alias("x")).select("dim", "c", "x.s", "x.v").collect()
    return [sorted((r.c, r.s if text[x] else r.v) for r in least if r.dim == i) for i, x in enumerate(names)]


def coordinate(column: str, edge: list[tuple[int, object]]) -> Column:
    """The coordinate of a value: that of the last edge which is not above it."""
    first, *rest = edge or [(0, None)]
    above = [F.when(F.col(column) >= F.lit(least), c) for c, least in reversed(rest)]
    return F.coalesce(*above, F.lit(first[0])).cast("int")


def interleaved(coordinates: list[Column], buckets: int = BUCKETS) -> Column:
    """The binary digits of the coordinates, highest first, one of each in turn."""
    z = F.lit(0).cast("long")
    for digit in reversed(range((buckets - 1).bit_length())):
        for c in coordinates:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(c, digit).bitwiseAND(F.lit(1)).cast("long"))
    return z


# --- layout ---------------------------------------------------------------------------------------------


def laid_out(rows: DataFrame, names: list[str], id_column: str, buckets: int = BUCKETS, per_file: int = ROWS) -> DataFrame:
    """rows with c0, c1, ... (coordinates of the columns named), z, position and file.

    rows is a table (it is read several times). The order is z, then id, null first; rows alike in both stand next to each other in
    any order. Null values are smallest. An empty table gives an empty result."""
    found = edges(rows, names, buckets)
    cells = rows.select("*", *[coordinate(x, e).alias(f"c{i}") for i, (x, e) in enumerate(zip(names, found, strict=True))])
    cells = cells.withColumn("z", interleaved([F.col(f"c{i}") for i in range(len(names))], buckets)).withColumn("row_", F.monotonically_increasing_id())
    out = places(cells, F.col("z"), F.col(id_column).asc_nulls_first(), F.col("row_"), name="layout-rows").drop("row_")
    return out.withColumn("file", F.expr(f"position div {per_file}"))


def bounds(placed: DataFrame, dims: int) -> list[Column]:
    """low0, high0, low1, ...: the least and largest coordinates of a row's file, over its rows (per_file at most)."""
    w = Window.partitionBy("file")
    return [f(f"c{i}").over(w).cast("int").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))]


def write_files(df: DataFrame, dims: dict[str, Column], id_column: str, path: str, buckets: int = BUCKETS, per_file: int = ROWS) -> DataFrame:
    """Writes df, all columns, as Parquet files of per_file rows in the order of the layout; returns the files' bounds (file,
    low0, high0, ...), from which cover_index() is made. dims: an expression of df's columns for each dimension."""
    plain = df.select(*[c.alias(f"dim{i}") for i, c in enumerate(dims.values())], F.col(id_column).alias("id"), F.struct(*[F.col(x) for x in df.columns]).alias("rest"))
    names = [f"dim{i}" for i in range(len(dims))]
    rows = written(laid_out(written(plain, "layout-source", free=False), names, "id", buckets, per_file), "layout-placed", free=False)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a file's rows fall into one partition and a partition starts with a file, so counting rows cuts where the layout does
    rows.repartitionByRange(parts, "file").sortWithinPartitions("position").select("rest.*").write.option("maxRecordsPerFile", per_file).mode("overwrite").parquet(path)
    return file_bounds(rows, len(dims))


def file_bounds(placed: DataFrame, dims: int) -> DataFrame:
    return placed.groupBy("file").agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))])


# --- bitmaps --------------------------------------------------------------------------------------------


def _bit() -> Column:
    """A row's file as a bit of its word of 64 files."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("file") % WORD).cast("int"))


def _word() -> Column:
    return F.floor(F.col("file") / WORD).alias("word")


def cover_index(files: DataFrame, dims: int, buckets: int = BUCKETS) -> DataFrame:
    """(word, b0, b1, ...): for each word of 64 files, bi[c] has the files whose bounds cover coordinate c of dimension i.
    files: (file, low0, high0, ...)."""
    covers = lambda i, c: F.bit_or(F.when((F.col(f"low{i}") <= c) & (F.col(f"high{i}") >= c), _bit()).otherwise(F.lit(0).cast("long")))
    return files.groupBy(_word()).agg(*[F.array(*[covers(i, c) for c in range(buckets)]).alias(f"b{i}") for i in range(dims)])


def member_index(placed: DataFrame, dims: int) -> DataFrame:
    """(c0, c1, ..., word, bits): the files that hold a row of the cell."""
    return placed.groupBy(*[f"c{i}" for i in range(dims)], _word()).agg(F.bit_or(_bit()).alias("bits"))


def files_touched(index: DataFrame, reach: list[int], buckets: int = BUCKETS) -> DataFrame:
    """(q0, q1, ..., files_touched): for each query (a coordinate of each dimension, and reach to either side), the number of files
    whose bounds meet it. A word goes on to the next dimension only with the coordinates that leave it a bit."""
    found = index.withColumn("bits", F.lit(-1).cast("long"))
    for i, far in enumerate(reach):
        near = [reduce(Column.bitwiseOR, [F.col(f"b{i}")[k] for k in range(max(0, c - far), min(buckets, c + far + 1))]) for c in range(buckets)]
        found = found.select("*", F.posexplode(F.array(*near)).alias(f"q{i}", "near")).withColumn("bits", F.col("bits").bitwiseAND(F.col("near"))).drop("near").filter("bits <> 0")
    return found.groupBy(*[f"q{i}" for i in range(len(reach))]).agg(F.sum(F.bit_count("bits")).cast("long").alias("files_touched"))


def files_matching(members: DataFrame, reach: list[int], buckets: int = BUCKETS) -> DataFrame:
    """(q0, q1, ..., files_matching): the number of files that hold a row within the query."""
    found = members
    for i, far in enumerate(reach):
        c = F.col(f"c{i}")
        near = F.explode(F.sequence(F.greatest(c - far, F.lit(0)), F.least(c + far, F.lit(buckets - 1)))) if far else c  # coordinates are ints
        found = found.select("*", near.alias(f"q{i}"))
    q = [f"q{i}" for i in range(len(reach))]
    return found.groupBy(*q, "word").agg(F.bit_or("bits").alias("bits")).groupBy(*q).agg(F.sum(F.bit_count("bits")).cast("long").alias("files_matching"))


def query_counts(placed: DataFrame, reach: list[int], buckets: int = BUCKETS) -> DataFrame:
    """(q0, q1, ..., files_touched, files_matching) of the query around each cell."""
    dims = len(reach)
    touched = files_touched(cover_index(file_bounds(placed, dims), dims, buckets), reach, buckets)
    return touched.join(files_matching(member_index(placed, dims), reach, buckets), [f"q{i}" for i in range(dims)])


DIMS, REACH = ["source", "lang", "length", "date"], [0, 0, 1, 1]


def document_values(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, length (UTF-8 bytes; null text: -1), date (crc32 of the decimal doc_id modulo 365; null id: of nothing)."""
    date = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 365
    return pick(docs, "doc_id", "source", "lang", "text").select(F.col("doc_id").cast("long"), "source", "lang", F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"), date.cast("long").alias("date"))


def cluster_documents(docs: DataFrame, buckets: int = BUCKETS, per_file: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, z, position, file, files_touched, files_matching, file_bounds.

    Null source and lang are smallest; null text has length -1; null ids come first among rows of equal z. Rows that repeat an id
    and its z have positions next to each other, in any order. Other columns are not looked at; an empty table gives an empty result."""
    dims = len(DIMS)
    rows = written(document_values(docs), "layout-values", free=False)
    placed = written(laid_out(rows, DIMS, "doc_id", buckets, per_file).drop(*DIMS), "layout-placed", free=False)
    counts = query_counts(placed, REACH, buckets)
    if buckets**dims <= BROADCAST_CELLS:
        counts = F.broadcast(counts)
    limits = F.concat_ws(",", *[f"{n}{i}" for i in range(dims) for n in ("low", "high")])
    own = placed.select("*", *bounds(placed, dims))
    out = own.join(counts, [F.col(f"c{i}") == F.col(f"q{i}") for i in range(dims)])
    return out.select("doc_id", "z", "position", F.col("file").cast("long").alias("file"), "files_touched", "files_matching", limits.alias("file_bounds"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_documents(table(spark, sf_dir, "documents"))


def _crc_sql(digits: str) -> str:
    """crc32 of a string of ASCII characters: eight steps a byte."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(acc, x), list_transform(range(8), lambda i: 0::BIGINT)), lambda c, i: {step})"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda y: ord(y)::BIGINT)), lambda acc, x: {byte}))"


def _layout_sql() -> str:
    z = " + ".join(f"((c{i} >> {2 - r}) & 1) * {1 << (11 - 4 * r - i)}" for r in range(3) for i in range(4))
    cs = ", ".join(f"(8 * (rank() OVER (ORDER BY {x} NULLS FIRST) - 1) // count(*) OVER ())::BIGINT AS c{i}" for i, x in enumerate(DIMS))
    ends = ", ".join(f"min(c{i}) AS low{i}, max(c{i}) AS high{i}" for i in range(4))
    meets = " AND ".join(f"low{i} <= q.c{i} + {r} AND high{i} >= q.c{i} - {r}" for i, r in enumerate(REACH))
    inside = " AND ".join(f"abs(m.c{i} - q.c{i}) <= {r}" for i, r in enumerate(REACH))
    cell = ", ".join(f"c{i}" for i in range(4))
    return f"""WITH v AS (SELECT doc_id, encode(source) AS source, encode(lang) AS lang, coalesce(strlen(text), -1) AS length, {_crc_sql("CAST(doc_id AS VARCHAR)")} % 365 AS date FROM documents),
    c AS (SELECT doc_id, {cs} FROM v), zs AS (SELECT *, ({z})::BIGINT AS z FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM zs), placed AS (SELECT *, position // 1000 AS file FROM p),
    f AS (SELECT file, {ends} FROM placed GROUP BY file), m AS (SELECT DISTINCT file, {cell} FROM placed), q AS (SELECT DISTINCT {cell} FROM placed),
    t AS (SELECT {", ".join(f"q.c{i}" for i in range(4))}, count(*) AS files_touched FROM q JOIN f ON {meets} GROUP BY ALL),
    g AS (SELECT {", ".join(f"q.c{i}" for i in range(4))}, count(DISTINCT m.file) AS files_matching FROM q JOIN m ON {inside} GROUP BY ALL)
    SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', low0, high0, low1, high1, low2, high2, low3, high3) AS file_bounds
    FROM placed JOIN f USING (file) JOIN t USING ({cell}) JOIN g USING ({cell})"""


QUERIES = {"op11_layout": op11_layout}
ORACLE = {"op11_layout": _layout_sql()}
