"""Personal data, in DataFrame expressions only: patterns propose spans, checksums (Luhn, mod 97) confirm them,
and words shortly before a span adjust its score.

Java's patterns below are possessive and start only where a run of their first characters starts (or where the last
match ended), which finds what the plain patterns find but in linear time and without deep recursion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without this (a fixed string, or a pattern if it starts with ~) has no match
    score: float
    context: str  # words that raise the score by 0.3 when they end within NEAR characters before the span
    base: bool = True


NEAR = 40
KEEP = 0.5  # spans of the added kinds need this score
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "~[0-9]\\.[0-9]", 0.6, "\\bip\\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "~[0-9][ -]?[0-9]", 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "~[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "~[0-9]{3}-[0-9]{2}-", 0.3, "ssn|social", False),
)
BLOCK = 128


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _mod97(iban: Column) -> Column:
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) < 65, 48).otherwise(55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: (acc * F.when(F.ascii(c) < 65, 10).otherwise(100) + code(c)) % 97) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.try_to_number(part(x), F.lit("999")) <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _found(df: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Adds the array 'found' to df with the column text. Matches and the pieces between them give the offsets."""
    keep = df.columns
    match = {k.name: F.when(F.rlike("text", F.lit(k.needs[1:])) if k.needs[0] == "~" else F.contains("text", F.lit(k.needs)), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))) for k in kinds}
    df = df.select(*keep, *[F.filter(m, lambda x: F.length(x) > 0).alias(f"m_{k}") for k, m in match.items()])
    piece = lambda x: F.struct(F.length(x).alias("n"), F.lower(F.right(x, F.lit(NEAR))).alias("near"))
    df = df.select("*", *[F.when(F.size(f"m_{k.name}") > 0, F.transform(F.split("text", k.pattern, -1), piece)).alias(f"p_{k.name}") for k in kinds])

    def steps(k: str) -> Column:
        return F.transform(f"m_{k}", lambda m, i: F.get(f"p_{k}", i)["n"] + F.length(m))

    df = df.select("*", *[steps(k.name).alias(f"s_{k.name}") for k in kinds])

    def blocks(k: str) -> Column:
        """Sums before each block of BLOCK steps, so that no prefix sum is longer than a block."""
        total = lambda b: F.aggregate(F.slice(f"s_{k}", b * BLOCK + 1, BLOCK), F.lit(0), lambda x, y: x + y)
        n = F.size(f"s_{k}")
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(b)))))

    df = df.select("*", *[blocks(k.name).alias(f"b_{k.name}") for k in kinds])

    def spans(k: Kind) -> Column:
        def one(m: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            before = F.get(f"b_{k.name}", b) + F.aggregate(F.slice(f"s_{k.name}", b * BLOCK + 1, i - b * BLOCK), F.lit(0), lambda x, y: x + y)
            p = F.get(f"p_{k.name}", i)
            score = F.lit(k.score) + F.when(p["near"].rlike(k.context), 0.3).otherwise(0.0)
            start = before + p["n"]
            return F.struct(F.lit(k.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"), _valid(k.name, m).alias("ok"))

        good = F.filter(F.transform(f"m_{k.name}", one), lambda x: x["ok"] if k.base else x["ok"] & (x["score"] >= KEEP))
        return F.coalesce(F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))), F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)"))

    return df.select(*keep, F.concat(*map(spans, kinds)).alias("found"))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row of docs: doc_id, text, found: array of (kind, start, end, score), by kind as in kinds, then by start.

    Offsets count code points, the end is exclusive. Null or empty text: nothing. Repeated rows are judged each for itself;
    an empty table gives an empty result; other columns are not looked at. Spans of different kinds may overlap."""
    return _found(pick(docs, "doc_id", "text"), kinds)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    counts = [_count("found", k).alias(f"n_{k}") for k in base]
    digest = F.sha2(_joined(F.filter("found", lambda x: x["kind"].isin(base))).cast("binary"), 256)
    return df.select("doc_id", *counts, digest.alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
