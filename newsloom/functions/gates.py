"""Summaries: built from sentences, and judged before they are published. One rule book for new and stored summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .similarity import near_duplicate, title_copy
from .text import any_of, editorial_key, is_junk, normalize, rejected_title_c, strip_numbering, vectorised

_SENTENCE = re.compile(r"\n+|(?<=[.!?…])\s+(?=[\"'“‘(]?[0-9A-Za-z가-힣])")
_WIDE = re.compile(r"\s{2,}|[^\S ]")  # white space but a single space
_BYLINE = re.compile(r"^(?:[가-힣]{2,4}\s*)?(?:기자|특파원)\s*[=:·-]?\s*")


def sentences(text: str | None) -> Iterator[str]:
    """Sentences up to the first marker of what is not the article, each made when it is asked for."""
    s = normalize(text)
    s = s[: min([len(s), *(at for m in fixed.CUT_MARKERS if (at := s.find(m)) >= 0)])]
    start = 0
    for m in chain(_SENTENCE.finditer(s), [None]):
        x = strip_numbering(s[start : m.start() if m else len(s)])
        x = x[b.end() :].strip() if (b := _BYLINE.match(x)) else x
        start = m.end() if m else len(s)
        if x:
            yield x


def candidates(text: str | None) -> list[str]:
    return list(sentences(text))


def tidy(line: str) -> str:
    return _WIDE.sub(" ", strip_numbering(line)).strip(",;:·|").strip()


def usable(line: str, title: str = "") -> bool:
    low, high = fixed.LINE_LENGTH
    s = tidy(line)
    return low <= len(s) <= high and not is_junk(line) and not re.search(r"(?:\.{3,}|…)\Z", s) and not (title and title_copy(s, title)) and not re.match(r"(?:기자|특파원|앵커)\s*[=:]", s)


def build_summary(title: str | None, raw: str | None, body: str | None, most: int = 3) -> str:
    """The first usable sentences that do not nearly repeat one another, numbered."""
    lines: list[str] = []
    for x in map(tidy, chain.from_iterable(map(sentences, (raw, body)))):
        if len(lines) >= most:
            break  # what follows is not even taken apart
        if usable(x, title or "") and not any(near_duplicate(y, x) for y in lines):
            lines.append(x)
    return "\n".join(f"{i}) {x}" for i, x in enumerate(lines, 1))


def stored_quality(title: str, summary: str, body: str = "") -> tuple[str, str]:
    s = build_summary(title, summary, body)
    n = len(s.split("\n")) if s else 0
    return s, "full" if n >= 3 else "short" if n else "none"


def rejected_title(title: str | None) -> bool:
    t = title or ""
    return bool(re.search(fixed.REJECTED_BARE, normalize(t), re.I) or "�" in t or t.count("?") >= 5 or re.search(fixed.REJECTED_PROMO, t, re.I) or re.search(fixed.REJECTED_EDITORIAL, t, re.I))


_POISON = [re.compile(p, re.I) for p in fixed.POISON]
_META = [re.compile(p) for p in fixed.AI_META]


def _lines(summary: str | None) -> list[str]:
    return [x for x in map(strip_numbering, normalize(summary).split("\n")) if x]


def _balanced(line: str) -> bool:
    return all(line.count(q) % 2 == 0 for q in "'\"") and all(line.count(a) == line.count(b) for a, b in ("()", "[]", "‘’", "“”"))


def _line_ok(line: str, title: str) -> bool:
    low, high = fixed.LINE_LENGTH
    return (
        low <= len(line) <= high
        and not any(p.search(line) for p in _POISON)
        and not is_junk(line)
        and not any(p.search(line) for p in _META)
        and not title_copy(line, title)
        and bool(re.search(r"다[.!]?\Z", line))
        and _balanced(line)
    )


def three_lines_ok(summary: str | None, title: str | None = "") -> bool:
    lines, title = _lines(summary), title or ""
    if rejected_title(title) or len(lines) != 3 or re.search(fixed.DEPENDENT_FIRST, lines[0]) or any(re.search(fixed.DETACHED_PARTICLE, x) for x in lines):
        return False
    return all(_line_ok(x, title) for x in lines) and not any(near_duplicate(lines[i], lines[j]) for i, j in ((0, 1), (0, 2), (1, 2)))


def relevance_words(title: str | None) -> list[str]:
    return [w for w in re.sub(r"[^0-9A-Za-z가-힣]+", " ", normalize(title)).split() if len(w) >= 2 and w not in fixed.RELEVANCE_STOPWORDS]


def mentions_title(summary: str | None, title: str | None) -> bool:
    """Some word of the title, or its stem, is in the summary; too few words in the title to tell: yes."""
    words = relevance_words(title)
    s = re.sub(r"[^0-9A-Za-z가-힣]+", "", normalize(summary))
    return len(words) < 3 or any(w in s or (len(w) >= 3 and w[:-1] in s) for w in words)


def reordered(summary: str | None, title: str | None) -> str:
    """The line nearest to the title comes first if the first line leans on another or is off the subject."""
    lines, words = [x for x in normalize(summary).split("\n") if x], relevance_words(title)
    if len(lines) != 3 or not words:
        return summary or ""
    plain = [strip_numbering(x) for x in lines]
    scores = [sum(w in x for w in words) for x in plain]
    best = scores.index(max(scores))
    if best == 0 or not (re.search(fixed.REORDER_DEPENDENT, plain[0]) or (scores[0] == 0 and scores[best] >= 2)):
        return summary or ""
    return "\n".join(f"{i}) {x}" for i, x in enumerate([plain[best], *(x for k, x in enumerate(plain) if k != best)], 1))


def general_ok(summary: str | None, title: str | None) -> bool:
    ordered, title = reordered(summary, title), title or ""
    if not three_lines_ok(ordered, title) or any(re.search(p, title, re.I) for p in fixed.GENERAL_TITLE):
        return False
    lines = _lines(ordered)
    if re.search(fixed.GENERAL_DEPENDENT_FIRST, lines[0]) or re.search(fixed.GENERAL_BROKEN_NUMBER, lines[0]) or any(re.search(p, x) for p in fixed.GENERAL_ARTIFACT for x in lines):
        return False
    keys = sorted(map(editorial_key, lines), key=len)
    return not any(len(keys[i]) >= 25 and keys[i][:40] in keys[j] for i, j in ((0, 1), (0, 2), (1, 2)))


def rejection_reason(summary: str | None, title: str | None, category: str | None) -> str:
    """The first check that fails, or '' for a summary that may be published."""
    lines = _lines(summary)
    if not normalize(summary):
        return "empty"
    if len(lines) != 3:
        return f"not_three_lines_{len(lines)}"
    checks = (
        ("rejected_title", lambda: rejected_title(title)),
        ("dependent_first_line", lambda: re.search(fixed.DEPENDENT_FIRST, lines[0])),
        ("detached_particle", lambda: any(re.search(fixed.DETACHED_PARTICLE, x) for x in lines)),
        ("three_line_checks", lambda: not three_lines_ok(summary, title)),
        ("title_not_mentioned", lambda: not mentions_title(summary, title)),
        ("general_editorial", lambda: category != "바둑" and not general_ok(summary, title)),
    )
    return next((name for name, fails in checks if fails()), "")


def publishable(summary: str | None, title: str | None, category: str | None) -> bool:
    return rejection_reason(summary, title, category) == ""


build_summary_column = vectorised(build_summary)
rejection_column = vectorised(rejection_reason)
reordered_column = vectorised(reordered)


def quality_conjuncts(title: Column, summary: Column, quality: Column, url: Column) -> list[Column]:
    """What a stored row must meet to be shown, one conjunct each."""
    shown = (quality == "duplicate") | ((quality == "full") & (F.trim(summary) != ""))
    hosts = [~F.contains(F.lower(url), F.lit(h)) for h in fixed.BLOCKED_HOSTS]
    return [shown, ~title.contains("�"), *hosts, *[~summary.contains(p) for p in fixed.SUMMARY_PHRASES], *[~title.contains(p) for p in fixed.TITLE_PHRASES]]


def promo_c(title: Column, names: Column) -> Column:
    return any_of(title, fixed.PROMO_TITLE, "") | names.contains(fixed.PROMO_OUTLET)


def title_rejected_c(title: Column) -> Column:
    return rejected_title_c(title)
