"""Text of articles. Functions of strings are plain Python; columns() makes Arrow UDFs of them, and what Spark can say itself
is a column expression."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_NUMBERING = re.compile(fixed.NUMBERING)
_AFTER = r"(?=\s|[,.;:!?]|$)"
_STEPS = [
    (re.compile(p, flags), to)
    for p, flags, to in (
        (r"\r\n?", 0, "\n"),
        (r"[\t\f\v ]+", 0, " "),
        (r" *\n *", 0, "\n"),
        (r"\n{3,}", 0, "\n\n"),
        (r"\s+([,.;:!?])", 0, r"\1"),
        (rf"([가-힣])\s+([{fixed.PARTICLES}]){_AFTER}", 0, r"\1\2"),
        (rf"([가-힣])\s+({'|'.join(fixed.LONG_PARTICLES)}){_AFTER}", 0, r"\1\2"),
        (r"\s+(['’”])(?=[은는이가을를와과의에도로](?:\s|[.,]))", 0, r"\1"),
        (r"([가-힣])\s+([’”])", 0, r"\1\2"),
        *((p, 0, to) for p, to in fixed.JOINED_WORDS),
    )
]
_PLAIN_STEPS = _STEPS[:5]  # those after have a Korean syllable in all that they find
_KOREAN = re.compile("[가-힣]")
#: Without any of these in it, a step leaves a text as it is.
_NEEDS = {r"[\t\f\v ]+": ("  ", "\t", "\f", "\v"), r" *\n *": (" \n", "\n ")}
_ENTITY_ORDER = ((r"&nbsp;|&#160;", " "), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"))


def _code_point(digits: str, base: int) -> str:
    try:
        return chr(int(digits, base))
    except (ValueError, OverflowError):
        return "�"


def normalize(value: str | None) -> str:
    """Tags and entities out, white space and Korean particles set right. '&amp;' goes before '&lt;', so '&amp;lt;' becomes '<'.

    Lines are normalised by each test they go through; those of usual length are remembered for a while."""
    return (_normal_line if len(value or "") <= 1000 else _normal)(value or "")


def _normal(value: str) -> str:
    s = re.sub(r"<[^>]+>", " ", value) if "<" in value else value
    s = _without_entities(s) if "&" in s else s
    for pattern, to in _STEPS if _KOREAN.search(s) else _PLAIN_STEPS:
        if any(x in s for x in _NEEDS.get(pattern.pattern, ("",))):
            s = pattern.sub(to, s)
    return s.strip()


def _without_entities(s: str) -> str:
    for pattern, to in _ENTITY_ORDER:
        s = re.sub(pattern, to, s, flags=re.I)
    s = re.sub(r"&([a-z][a-z0-9]+);", lambda m: fixed.ENTITIES.get(m[1].lower(), m[0]), s, flags=re.I)
    s = re.sub(r"&quot;|&#34;", '"', s, flags=re.I)
    s = re.sub(r"&#39;|&apos;", "'", s, flags=re.I)
    s = re.sub(r"&#x([0-9a-f]+);", lambda m: _code_point(m[1], 16), s, flags=re.I)
    return re.sub(r"&#([0-9]+);", lambda m: _code_point(m[1], 10), s)


_normal_line = lru_cache(1 << 12)(_normal)


def strip_numbering(value: str | None) -> str:
    return (_stripped_line if len(value or "") <= 1000 else _stripped)(value or "")


def _stripped(value: str) -> str:
    s = normalize(value)
    m = _NUMBERING.match(s)
    return (s[m.end() :] if m else s).strip()


_stripped_line = lru_cache(1 << 12)(_stripped)


def comparison_key(value: str | None) -> str:
    return re.sub(r"[^0-9a-z가-힣]", "", strip_numbering(value).lower())


def editorial_key(value: str | None) -> str:
    return re.sub(r"[^0-9A-Za-z가-힣]", "", normalize(value)).lower()


def strip_html(value: str | None) -> str:
    s = re.sub(r"<(?:br|/p|/div|/li|/h[1-6])\b[^>]*>", "\n", value or "", flags=re.I)
    return normalize(re.sub(r"<[^>]*>", " ", s))


def clean_title(value: str | None) -> str:
    s = re.sub(fixed.TITLE_PRESS, "", strip_html(value))
    return re.sub(r"\s+", " ", s).strip()[: fixed.TITLE_LENGTH]


def clean_press(value: str | None) -> str:
    s = re.sub(r"\s+(?:[-|–—]|·)\s+(?:[^\n]{2,})\Z", "", strip_html(value))
    return re.sub(r"\s*(?:대한민국|울산)\s*(?:최초|최고)[^\n]*\Z", "", s).strip()[: fixed.PRESS_LENGTH]


def press_from_title(value: str | None) -> str:
    m = re.search(r"\s[-|–—]\s([^\-|–—]{1,30})\Z", strip_html(value))
    return clean_press(m[1]) if m else ""


_BODY_JUNK, _CAPTION = re.compile(fixed.BODY_JUNK, re.I), re.compile(fixed.CAPTION, re.I)


def clean_body(value: str | None) -> str:
    lines = (x.strip() for x in normalize(value).split("\n"))
    return "\n".join(x for x in lines if len(x) >= 12 and not _BODY_JUNK.search(x) and not _CAPTION.search(x))[: fixed.BODY_LENGTH]


_JUNK = [re.compile(p, re.I) for p in fixed.JUNK_LINE]


def is_junk(value: str | None) -> bool:
    line = strip_numbering(value)
    return len(line) < 8 or len(re.findall(r"#[0-9A-Za-z가-힣_]+", line)) >= 2 or any(p.search(line) for p in _JUNK)


def outlet(press: str | None, url: str | None, source: str | None) -> str:
    """Press, else the outlet of the portal's article number, else the portal, else the host's outlet, else the source."""
    if name := clean_press(press):
        return name
    if (m := re.search(r"/article/(\d{3})/", url or "")) and m[1] in fixed.NAVER_OUTLETS:
        return fixed.NAVER_OUTLETS[m[1]]
    if source in fixed.SOURCE_OUTLETS:
        return fixed.SOURCE_OUTLETS[source]
    name = clean_press(source)
    return fixed.HOST_OUTLETS.get(re.sub(r"^www\.", "", name), name or "기타")


def vectorised(f, kind: T.DataType = T.StringType()):
    """f of one or more strings as an Arrow-batched UDF."""
    return F.pandas_udf(lambda *cols: pd.Series([f(*row) for row in zip(*cols, strict=True)]), kind)


normalize_column = F.pandas_udf(lambda s: s.map(normalize), T.StringType())
clean_title_column = F.pandas_udf(lambda s: s.map(clean_title), T.StringType())

# --- column expressions: what they take is already normalised -------------------------------------


def any_of(c: Column, patterns, flags: str = "(?i)") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(flags + p)
    return out


def clean_title_c(c: Column) -> Column:
    """clean_title(): what follows a last dash or bar goes, white space is single."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, fixed.TITLE_PRESS, ""), r"\s+", " ")), 1, fixed.TITLE_LENGTH)


def strip_numbering_c(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, fixed.NUMBERING, ""))


def comparison_key_c(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_numbering_c(c)), "[^0-9a-z가-힣]+", "")


def junk_c(c: Column) -> Column:
    line = strip_numbering_c(c)
    return (F.length(line) < 8) | (F.size(F.regexp_extract_all(line, F.lit("#[0-9A-Za-z가-힣_]+"), F.lit(0))) >= 2) | any_of(line, fixed.JUNK_LINE)


def clean_body_c(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n+"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike("(?i)" + fixed.BODY_JUNK) & ~x.rlike("(?i)" + fixed.CAPTION))
    return F.substring(F.array_join(good, "\n"), 1, fixed.BODY_LENGTH)


#: What may stand before and after a word, or not, does not decide whether it is found, but is tried at every place of a text.
_ASIDE = ((r"\[?[^\]\n]{0,20}(?:칼럼", "(?:칼럼"), (r"오피니언)\]?", "오피니언)"))
EDITORIAL_FOUND = reduce(lambda p, x: p.replace(*x, 1), _ASIDE, fixed.REJECTED_EDITORIAL)


def rejected_title_c(c: Column) -> Column:
    """Whatever the patterns find has a Korean syllable, so texts without one are looked through once."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    found = c.rlike("(?i)" + fixed.REJECTED_BARE) | c.rlike("(?i)" + fixed.REJECTED_PROMO) | c.rlike("(?i)" + EDITORIAL_FOUND)
    return c.contains("�") | (marks >= 5) | (c.rlike("[가-힣]") & found)


def relevant_c(title: Column, body: Column) -> Column:
    """Go news: a strong title, or context and action in the title, or two signals and action at the start of the body."""
    start = F.substring(body, 1, 5000)
    signals = sum((start.rlike("(?i)" + p).cast("int") for p in fixed.BADUK_SIGNALS), F.lit(0))
    by_title = title.rlike("(?i)" + fixed.BADUK_TITLE) | (title.rlike("(?i)" + fixed.BADUK_CONTEXT) & title.rlike("(?i)" + fixed.BADUK_ACTION))
    return by_title | ((signals >= 2) & start.rlike("(?i)" + fixed.BADUK_ACTION))


def display_relevant_c(title: Column, body: Column) -> Column:
    return relevant_c(title, body) | F.concat_ws(" ", title, body).rlike("(?i)" + fixed.BADUK_DISPLAY)


def first_rule(c: Column, rules) -> Column:
    """Name of the first rule whose pattern is found, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def classify_c(category: Column, title: Column, body: Column, rules=fixed.TOPIC_RULES) -> Column:
    """The topic by title, else by the first 800 characters of the body, else the category as it is."""
    start = F.substring(body, 1, 800)
    other = F.when(category == "바둑", "기타").otherwise(category)
    return F.when(relevant_c(title, start), "바둑").otherwise(F.coalesce(first_rule(title, rules), first_rule(start, rules), other))


def numbers_c(c: Column) -> Column:
    """Distinct numbers, without thousands commas."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, "(?<=[0-9]),(?=[0-9])", ""), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def numbers_grounded_c(summary: Column, source: Column) -> Column:
    return F.size(F.array_except(numbers_c(summary), numbers_c(source))) == 0


def words_c(c: Column, stop: tuple[str, ...], pattern: str = "[0-9A-Za-z가-힣]{2,}") -> Column:
    """Distinct words that are neither in stop nor all digits."""
    found = F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), F.array(*map(F.lit, stop)))
    return F.filter(found, lambda w: ~w.rlike("^[0-9]+$"))


def title_words_c(title: Column) -> Column:
    return words_c(title, fixed.TITLE_STOPWORDS)


def outlet_c(press: Column, url: Column, source: Column) -> Column:
    """outlet() for press and source names that are clean already."""
    by_number = F.create_map(*[F.lit(x) for kv in fixed.NAVER_OUTLETS.items() for x in kv])[F.regexp_extract(url, r"/article/(\d{3})/", 1)]
    by_source = F.create_map(*[F.lit(x) for kv in fixed.SOURCE_OUTLETS.items() for x in kv])[source]
    by_host = F.create_map(*[F.lit(x) for kv in fixed.HOST_OUTLETS.items() for x in kv])[F.regexp_replace(source, r"^www\.", "")]
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(press), by_number, by_source, by_host, some(source), F.lit("기타"))
