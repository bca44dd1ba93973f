"""Four similarity measures of titles and lines, kept apart on purpose, and rules made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import clean_title, comparison_key

# --- of strings -------------------------------------------------------------------------------------


def bigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 2] for i in range(len(s) - 1))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def _plain(title: str) -> str:
    return re.sub(r"[^0-9A-Za-z가-힣]", "", title).lower()


def title_similarity(a: str, b: str) -> float:
    """Dice of overlapping bigrams of cleaned titles; equal ones have 1, empty ones 0."""
    x, y = _plain(clean_title(a)), _plain(clean_title(b))
    return 0.0 if not x or not y else 1.0 if x == y else dice(bigrams(x), bigrams(y))


def near_duplicate(a: str, b: str) -> bool:
    """Equal keys, or one of 14 or more characters within the other, or 0.82 of the two-character chunks in common."""
    x, y = comparison_key(a), comparison_key(b)
    if not x or not y:
        return False
    if x == y or (min(len(x), len(y)) >= 14 and (x in y or y in x)):
        return True
    p, q = ({s[i : i + 2] for i in range(0, len(s), 2)} for s in (x, y))
    return len(p & q) / max(len(p), len(q)) >= 0.82


def title_copy(line: str, title: str) -> bool:
    x, y = comparison_key(line), comparison_key(title)
    return bool(x and y) and (x == y or (abs(len(x) - len(y)) <= 6 and near_duplicate(line, title)))


def headline_match(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 18 and (a in b or b in a))


def without_series(title: str) -> str:
    return re.sub(fixed.SERIES_TAG, "", title).strip()


class Story:
    """What is compared of a title, computed once."""

    __slots__ = ("title", "whole", "tail", "grams", "tail_grams", "serials", "words")

    def __init__(self, title: str | None):
        self.title = clean_title(title)
        self.whole, self.tail = _plain(self.title), _plain(clean_title(without_series(self.title)))
        self.grams, self.tail_grams = bigrams(self.whole), bigrams(self.tail)
        self.serials = frozenset(re.findall(r"[0-9]{3,}", self.title))
        self.words = frozenset(w for w in re.findall(r"[0-9A-Za-z가-힣]{2,}", self.title) if w not in fixed.TITLE_STOPWORDS and not re.fullmatch(r"[0-9]+", w))

    def same(self, other: Story, least: float = fixed.SAME_STORY) -> bool:
        """Alike with and without the series tag, and no serial numbers that differ."""
        if not self.title or not other.title or (self.serials and other.serials and not self.serials & other.serials):
            return False
        near = lambda a, b, g, h: bool(a and b) and (a == b or dice(g, h) >= least)
        return near(self.whole, other.whole, self.grams, other.grams) and near(self.tail, other.tail, self.tail_grams, other.tail_grams)

    def shares_words(self, other: Story, least: int = 3) -> bool:
        return len(self.words & other.words) >= least


def issue_words(title: str) -> frozenset[str]:
    return frozenset(re.findall(r"[0-9a-z가-힣]{2,}", title.lower())) - set(fixed.ISSUE_GENERIC)


def same_issue(a: str, b: str) -> bool:
    """Not if both name divisions and share none; else one distinctive word or three words in common."""
    x, y = ({d for d in fixed.ISSUE_DIVISIONS if d in t} for t in (a, b))
    if x and y and not x & y:
        return False
    shared = issue_words(a) & issue_words(b)
    return len(shared) >= 3 or any(len(w) >= 5 or re.search("(?:배|컵|은행|그룹|기원)$", w) for w in shared)


# --- of columns -------------------------------------------------------------------------------------


def plain_c(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", "")


def bigrams_c(plain: Column) -> Column:
    """Distinct overlapping bigrams of a plain key, of any length: its characters are taken apart once, not once a bigram."""
    letters = F.split(plain, "")
    return F.array_distinct(F.array_compact(F.zip_with(letters, F.slice(letters, 2, F.length(plain) + 1), lambda x, y: F.concat(x, y))))


def chunks_c(key: Column) -> Column:
    """Distinct two-character pieces, without overlap. They are cut off one after the other; to look each up by its place would count
    characters from the start each time."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit("(?s)..?"), F.lit(0)))


def dice_c(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def near_duplicate_c(a: Column, b: Column, p: Column | None = None, q: Column | None = None) -> Column:
    """near_duplicate() of comparison keys; p and q are their chunks_c(), where these are there already."""
    p, q = chunks_c(a) if p is None else p, chunks_c(b) if q is None else q
    inside = (F.least(F.length(a), F.length(b)) >= 14) & (a.contains(b) | b.contains(a))
    return (a != "") & (b != "") & ((a == b) | inside | (F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q)) >= 0.82))
