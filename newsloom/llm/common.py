"""Shared helpers of the training-data operators: column picking, tables in the shared folder,
vectorised word hashing and bounded Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting, what a write shuffled is removed when the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(df: DataFrame, name: str) -> int:
    """Where the column stands. An exact name wins over one that differs in case, so that extra columns never clash."""
    have = df.columns
    return have.index(name) if name in have else [x.lower() for x in have].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """Columns named by place, so that no two clash. Rows go to Python in batches of a few MB, whatever the length of texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        df.sparkSession.conf.set(key, str(most))
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns."""
    return numbered(df).select(*[F.col(f"c{place(df, x)}").alias(x) for x in names])


def carried(df: DataFrame, *names: str) -> DataFrame:
    """pick(), and all columns of df as the struct 'rest', which restored() takes apart."""
    rest = F.struct(*[F.col(f"c{i}") for i in range(len(df.columns))]).alias("rest")
    return numbered(df).select(*[F.col(f"c{place(df, x)}").alias(x) for x in names], rest)


def restored(df: DataFrame, like: DataFrame, *more: str, **new) -> DataFrame:
    """The columns of like out of 'rest', with new ones in the place of those that place() finds for their names, and more columns of df."""
    instead = {place(like, k): c for k, c in new.items() if k.lower() in [x.lower() for x in like.columns]}
    out = df.select(*[instead.get(i, F.col("rest").getField(f"c{i}")).alias(f"c{i}") for i in range(len(like.columns))], *more)
    return out.toDF(*like.columns, *more)


def filtered(df: DataFrame, keep) -> DataFrame:
    """The rows of df, all columns, for whose texts keep() (made once a task by calling it) says so."""
    at = place(df, "text")

    def run(batches):
        judge = keep()
        for b in text_batches(batches, text=f"c{at}"):
            yield b.filter(pa.array(judge(b.column(at).to_pylist()), pa.bool_()))

    plain = numbered(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only where it is unset, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        told = f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor. free: what was shuffled goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)
    del df
    if free:
        gc.collect()
        spark._jvm.System.gc()  # Spark removes the shuffle files of plans that nothing holds any more
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_batches(batches, most_bytes: int = 1 << 20, most_rows: int = 4096, text: str = "text"):
    """Arrow batches cut so that each holds about most_bytes of text; one longer text makes a batch of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        at, total = 0, 0
        for i in range(n):
            if i > at and (total + sizes[i] > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += sizes[i]
        yield batch.slice(at, n - at)


# --- words as 64-bit hashes -------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; kept for texts of usual length only."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, 1 << 20)
    out = []
    for base in (_BASE, _INV):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    if size <= 1 << 22:
        _powers[:] = out
    return out[0][:n], out[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash of each word, index of each text's first word and the total, start bytes, end bytes, bytes). Null: no words.

    A word is a run of anything but ASCII white space; lower turns A-Z into a-z first. Equal words have equal hashes."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = b"\n" + b"\n".join(parts) + b"\n"
    if lower:
        buf = buf.lower()  # bytes.lower() turns ASCII letters only
    a = np.frombuffer(buf, dtype=np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    first = np.cumsum([1] + [len(p) + 1 for p in parts])
    ptr = np.searchsorted(starts, first)
    if not len(starts):
        return np.zeros(0, np.uint64), ptr, starts, ends, buf
    power, inverse = _power_tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), ptr, starts, ends, buf


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)
