"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings,
with an allow-list. The entropy of a window is kept up to date by its character counts."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_batches

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_base64")
BASE = KINDS[:3]
WINDOW = 24
#: Bits a character from which a window counts, by class; 24 random characters have about 3.5 of 4 and 4.3 of 6 bits.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-F]{24,}|[0-9a-f]{24,}"), 3.0),
    ("entropy_lower", re.compile(r"[0-9a-z]{24,}"), 3.7),
    ("entropy_upper", re.compile(r"[0-9A-Z]{24,}"), 3.7),
    ("entropy_base64", _CANDIDATE, 4.0),
)
#: Strings that look random but are no secrets: one character or a sequence repeated, UUIDs, alphabets, placeholders, paths.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"(.{1,8})\1{2,}",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"(?i)abcdefghij|0123456789|qwertyuiop",
        r"(?i)example|placeholder|changeme|dummy|sample|xxxx",
        r"(?<![a-z])(?:[a-z]{2,}+[/_-]){3,}",  # tried once a run of letters, so that a long one takes no more than its length
    )
)
_XLOGX = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def windows_over(s: str, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of s with at least so many bits a character. A character in, one out: counts, no rescan."""
    if len(s) < window:
        return []
    log = _XLOGX if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    count: dict[str, int] = {}
    total, out = 0.0, []
    most = (math.log2(window) - bits) * window + 1e-9  # H >= bits as the sum of c * log2(c) <= most
    for i, c in enumerate(s):
        if i >= window:
            gone = s[i - window]
            n = count[gone]
            total += log[n - 1] - log[n]
            count[gone] = n - 1
        n = count.get(c, 0)
        total += log[n + 1] - log[n]
        count[c] = n + 1
        if i >= window - 1 and total <= most:
            if out and out[-1][1] >= i - window + 1:
                out[-1][1] = i + 1
            else:
                out.append([i - window + 1, i + 1])
    return [tuple(x) for x in out]


def mixed(s: str) -> bool:
    """Keys mix cases and digits; long words do not."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def spread(s: str) -> bool:
    """Keys of one case have digits among their letters; words with a number at an end do not."""
    return len(re.findall(r"[0-9]+", s)) >= 3


SHAPED = {"entropy_hex": lambda s: True, "entropy_lower": spread, "entropy_upper": spread, "entropy_base64": mixed}


def allowed(s: str) -> bool:
    """Most of the string is in parts that look random but are no secrets; a short run inside a key is no such thing."""
    inside = bytearray(len(s))
    for p in ALLOW:
        for m in p.finditer(s):
            inside[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return len(s) - sum(inside) < WINDOW / 2 or 2 * sum(inside) >= len(s)


def united(spans) -> list[list[int]]:
    """The spans as disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def uncovered(start: int, end: int, taken: list[list[int]]) -> list[tuple[int, int]]:
    """The parts of a candidate outside the spans reported already, which are disjoint and in order: only those it meets are looked at."""
    out = []
    for i in range(bisect_right(taken, start, key=lambda x: x[1]), len(taken)):
        a, b = taken[i]
        if a >= end:
            break
        if start < a:
            out.append((start, a))
        start = max(start, b)
    return out + [(start, end)] * (start < end)


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then by kind. The fixed kinds score 1, the others their share of what their class can have."""
    if not text:
        return []
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    taken = united((a, b) for _, a, b, _ in out)
    added: list[tuple[str, int, int, float]] = []
    for m in _CANDIDATE.finditer(text):
        for start, end in uncovered(m.start(), m.end(), taken) if taken else [m.span()]:
            part, mine = text[start:end], []
            for kind, shape, bits in CLASSES:
                before = united(q[1:3] for q in mine)  # windows of one class are disjoint, so that only those of the classes before it count
                for run in shape.finditer(part):
                    for a, b in windows_over(run[0], bits):
                        for x, y in uncovered(start + run.start() + a, start + run.start() + b, before):
                            s = text[x:y]
                            if y - x >= WINDOW and SHAPED[kind](s) and not allowed(s):
                                mine.append((kind, x, y, bits / math.log2(WINDOW)))
            added += mine
    return sorted(out + added, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, secrets: array of (kind, start, end, score, value) by start, then kind.

    Offsets count code points, the end is exclusive. Null or empty text: nothing. The allow-list holds for the entropy kinds
    only. Repeated rows are judged each for itself; empty tables give empty results; other columns are not looked at."""

    def run(batches):
        for b in text_batches(batches):
            rows = []
            for t in b.column(1).to_pylist():
                rows.append([{"kind": k, "start": x, "end": y, "score": s, "value": t[x:y]} for k, x, y, s in scan(t)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "secrets"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long,score:double,value:string>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_secrets(table(spark, sf_dir, "documents"))
    counts = [_count("secrets", k).alias(f"n_{k}") for k in BASE]
    digest = F.sha2(_joined(F.filter("secrets", lambda x: x["kind"].isin(*BASE))).cast("binary"), 256)
    return df.select("doc_id", *counts, digest.alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


QUERIES = {"op2_secrets": op2_secrets}
