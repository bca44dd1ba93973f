"""Model calls behind one interface. The default answers by rules alone, so everything works without a network."""

from __future__ import annotations

import json
import textwrap
from typing import Protocol

from .functions.gates import build_summary, publishable
from .functions.similarity import Story, dice, same_issue, without_series
from .functions.text import clean_title, normalize


class Provider(Protocol):
    def summarise(self, title: str, raw: str, body: str) -> str: ...

    def group(self, articles: list[dict], cache: list[dict]) -> str: ...

    def judge(self, titles: list[str], known: list[str]) -> str: ...

    def retitle(self, titles: list[str]) -> str: ...


class Rules:
    """Sentences of the text as a summary; stories and issue titles that match as groups."""

    def summarise(self, title: str, raw: str, body: str) -> str:
        return build_summary(title, raw, body)

    def group(self, articles: list[dict], cache: list[dict]) -> str:
        groups: list[dict] = []
        for i, a in enumerate(articles):
            story = Story(a["title"])
            home = next((g for g in groups if any(story.same(s) or (a.get("category") != "바둑" and story.shares_words(s)) for s in g["stories"])), None)
            if home:
                home["indices"].append(i)
                home["stories"].append(story)
            else:
                groups.append({"title": story.title[:40], "indices": [i], "stories": [story]})
        for g in groups:
            known = next((c["title"] for c in cache if same_issue(c["title"], g["title"])), None)
            g["title"] = known or g["title"]
        return json.dumps([{"title": g["title"], "indices": g["indices"], "main": g["indices"][0]} for g in groups if g["title"]], ensure_ascii=False)

    def judge(self, titles: list[str], known: list[str]) -> str:
        """New titles that tell a known story, or share two words and a third of the bigrams with it: [{"new": 0, "same": 3}]."""
        stories = [Story(t) for t in known]
        near = lambda a, b: a.same(b) or (a.shares_words(b, 2) and dice(a.grams, b.grams) >= 1 / 3)
        found = ((i, next((k for k, s in enumerate(stories) if near(s, Story(t))), None)) for i, t in enumerate(titles))
        return json.dumps([{"new": i, "same": k} for i, k in found if k is not None])

    def retitle(self, titles: list[str]) -> str:
        """Titles without the tag of a column, up to the last word that fits: [{"index": 0, "title": "..."}]."""
        short = (textwrap.shorten(clean_title(without_series(clean_title(t))), 40, placeholder="") for t in titles)
        return json.dumps([{"index": i, "title": t} for i, t in enumerate(short) if t], ensure_ascii=False)


def numbers(text: str) -> set[str]:
    import re

    return set(re.findall(r"[0-9]+(?:\.[0-9]+)?", re.sub(r"(?<=[0-9]),(?=[0-9])", "", re.sub(r"(?m)^\s*[0-9][.)]\s*", "", text))))


def normalised_answer(answer: str) -> str:
    """A model's answer as up to three numbered lines."""
    import re

    s = re.sub(r"```[a-z]*", "", re.sub(r"<[^>]+>", " ", answer or "")).strip()
    lines = [x.strip() for x in s.split("\n") if re.match(r"\s*[1-3][.)]", x)]
    if len(lines) < 3:
        lines = [x.strip() for x in re.split(r"(?<=다\.)\s+", normalize(s)) if x.strip()]
    return "\n".join(f"{i}) {re.sub(r'^[1-3][.)]\s*', '', x)}" for i, x in enumerate(lines[:3], 1))


def best_summary(provider: Provider, title: str, raw: str, body: str, category: str, extractive: bool = True) -> str:
    """A provider's summary if it may be published and all its numbers are in the source; else sentences of the text, if they may."""
    source = normalize(f"{raw}\n{body}")[:2500]
    made = normalised_answer(provider.summarise(title, raw, source)) if len(source) >= 300 else ""
    for s in (made, build_summary(title, raw, body) if extractive else ""):
        if s and publishable(s, title, category) and numbers(s) <= numbers(f"{title} {source}"):
            return s
    return ""
