"""Search in title, summary and press by a table of trigrams: candidates are the articles that have all trigrams of the term, and
those are then held against the term itself, so that the rows are those of a scan.

The table has a row for each trigram of each article, in folders by a hash of the trigram: a search reads the folders of its term's
trigrams and no others. Within a folder rows are dealt to files by article too, so that a trigram which a third of all articles
have is no task of its own. Articles that come or change are appended: what an article no longer has is found out when
it is held against the term, and a row that is there twice counts once."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
FIELDS = ("title", "summary", "press")
FOLDERS = 64  # of a table of trigrams; a table is read with the number it was written with
WORD_BITS = 60


def like_pattern(term: str) -> str:
    """The term anywhere, with what LIKE reads as a wildcard taken as it is."""
    return "%" + "".join("\\" + c if c in "\\%_" else c for c in term) + "%"


def has_term(term: str, fields: tuple[str, ...] = FIELDS) -> Column:
    return reduce(or_, [F.col(f).ilike(like_pattern(term)) for f in fields])


def term_grams(term: str) -> list[str]:
    """The trigrams of a term, in lower case; only those whose letters are ASCII or know no case, as others may be lowered differently
    here than in Spark. A term shorter than that has none."""
    plain = [c.lower() if c.isascii() or c.lower() == c.upper() else None for c in term]
    windows = (plain[i : i + GRAM] for i in range(len(plain) - GRAM + 1))
    return sorted({"".join(w) for w in windows if None not in w})


def folder_of(gram: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(folders)).cast("int")


#: Every place of a text with two characters behind it, but for the middle of a character that Java keeps in two halves.
_EACH = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(" + "." * GRAM + "))"


def _grams(text: Column) -> Column:
    """The trigrams of a text, found in one pass. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_EACH), F.lit(1))


def trigrams(articles: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, folders: int = FOLDERS) -> DataFrame:
    """(gram, key, folder): a row for each different trigram of an article. No trigram spans two fields."""
    all_of = F.array_distinct(F.concat(*[_grams(F.col(f)) for f in fields]))
    return articles.select(F.col(key), F.explode(all_of).alias("gram")).select("gram", key, folder_of(F.col("gram"), folders).alias("folder"))


def append_trigrams(articles: DataFrame, path: str, key: str = "id", fields: tuple[str, ...] = FIELDS, folders: int = FOLDERS, files: int = 8) -> None:
    """Adds the trigrams of these articles to the table at path, each folder in up to so many files, sorted by trigram."""
    rows = trigrams(articles, key, fields, folders)
    dealt = rows.repartition("folder", F.pmod(F.xxhash64(key), F.lit(files))).sortWithinPartitions("folder", "gram")
    dealt.write.mode("append").partitionBy("folder").parquet(path)


def read_trigrams(spark: SparkSession, path: str, like: DataFrame, key: str = "id") -> DataFrame:
    """The table at path, whose key is of the type that like has."""
    kind = like.schema[key].dataType.simpleString()
    return spark.read.schema(f"gram string, {key} {kind}, folder int").parquet(path)


def candidates(table: DataFrame, term: str, key: str = "id", folders: int = FOLDERS) -> DataFrame | None:
    """The keys that have all trigrams of the term, or None where the term has none. A bit a trigram: rows are summed before they move."""
    grams = term_grams(term)
    if not grams:
        return None
    place = F.array_position(F.array(*[F.lit(g) for g in grams]), F.col("gram")) - 1
    masks, full = [], []
    for k in range(0, len(grams), WORD_BITS):
        mine = F.when((place >= k) & (place < k + WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), (place - k).cast("int")))
        masks.append(F.bit_or(mine).alias(f"m{k}"))
        full.append(F.col(f"m{k}") == F.lit((1 << min(WORD_BITS, len(grams) - k)) - 1).cast("long"))
    found = table.filter(F.col("folder").isin(sorted({crc32(g.encode()) % folders for g in grams})) & F.col("gram").isin(grams)).groupBy(key).agg(*masks)
    return found.filter(reduce(and_, full)).select(key)


def matching(articles: DataFrame, term: str, table: DataFrame | None = None, key: str = "id", fields: tuple[str, ...] = FIELDS, folders: int = FOLDERS) -> DataFrame:
    """The articles that have the term in a field, whatever its case. Without a table, or for a term without trigrams, by a scan."""
    found = None if table is None else candidates(table, term, key, folders)
    rows = articles if found is None else articles.join(found, key, "left_semi")
    return rows.filter(has_term(term, fields))
