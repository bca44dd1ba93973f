"""normalize() leaves out steps that find nothing; what it gives is that of all steps."""

import random
import re

from newsloom.functions import fixed
from newsloom.functions import gates
from newsloom.functions import text as X

AFTER = r"(?=\s|[,.;:!?]|$)"
ALL = [
    (r"\r\n?", "\n"), (r"[\t\f\v ]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"\s+([,.;:!?])", r"\1"), (rf"([가-힣])\s+([{fixed.PARTICLES}]){AFTER}", r"\1\2"),
    (rf"([가-힣])\s+({'|'.join(fixed.LONG_PARTICLES)}){AFTER}", r"\1\2"), (r"\s+(['’”])(?=[은는이가을를와과의에도로](?:\s|[.,]))", r"\1"), (r"([가-힣])\s+([’”])", r"\1\2"), *fixed.JOINED_WORDS,
]


def by_all_steps(value):
    s = re.sub(r"<[^>]+>", " ", value)
    for p, to in ((r"&nbsp;|&#160;", " "), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">")):
        s = re.sub(p, to, s, flags=re.I)
    s = re.sub(r"&([a-z][a-z0-9]+);", lambda m: fixed.ENTITIES.get(m[1].lower(), m[0]), s, flags=re.I)
    s = re.sub(r"&#39;|&apos;", "'", re.sub(r"&quot;|&#34;", '"', s, flags=re.I), flags=re.I)
    s = re.sub(r"&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16)), s, flags=re.I)
    s = re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])), s)
    for p, to in ALL:
        s = re.sub(p, to, s)
    return s.strip()


def test_steps_left_out_change_nothing():
    r = random.Random(8)
    bits = ["a", "b ", " ", "\t", "\n", "\r", "\f", " \n", ".", ",", "<b>", "<", ">", "&amp;", "&lt;", "&#44032;", "&#x41;", "&nbsp;", "가", "나 ", "은", "에서", "’", "고등 학교", "바둑 협회"]
    for plain in (True, False):
        for _ in range(4000):
            value = "".join(r.choices(bits[:15] if plain else bits, k=r.randint(0, 12)))
            assert X.normalize(value) == by_all_steps(value), repr(value)


def test_a_line_is_taken_apart_once_and_only_if_its_length_allows(monkeypatch):
    asked = []
    monkeypatch.setattr(gates, "is_junk", lambda line: asked.append(line) or False)
    gates.build_summary("", "", "short.\n" * 50 + "A line that is long enough to be one of a summary, certainly.")
    assert len(asked) == 1


def test_tidy_as_by_patterns():
    r = random.Random(9)
    for _ in range(4000):
        line = "".join(r.choices(["a", "가", " ", "  ", "\t", "\n", "　", ",", ";", "|", "·", "1) ", "-"], k=r.randint(0, 9)))
        want = re.sub(r"^[,;:·|]+|[,;:·|]+\Z", "", re.sub(r"\s+", " ", re.sub(fixed.NUMBERING, "", by_all_steps(line), count=1).strip())).strip()
        assert gates.tidy(line) == want, repr(line)
