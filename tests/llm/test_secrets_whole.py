"""Added secrets of any length and class are found, beside base spans too."""

import random
import time

import pytest
from newsloom.llm import secrets


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_random_keys_of_any_length(alphabet):
    rnd = random.Random(8)
    for n in (40, 64, 128, 400, 1600):
        keys = ["".join(rnd.choices(alphabet, k=n)) for _ in range(40)]
        found = sum(any(k.startswith("entropy") or k == "hex" for k, *_ in secrets.scan(f"a {x} b")) for x in keys)
        assert found >= 39, (n, found)


def test_parts_beside_a_base_span():
    key = "qZ7rT2xV9bN4mK8pL3wD6cF1sH5g"
    text = f"{key}/0123456789abcdef01234567"
    assert any(k == "entropy_base64" and a == 0 and b >= len(key) for k, a, b, _ in secrets.scan(text))


def test_what_is_no_secret_stays_out():
    for t in ("xyz" * 20, "123e4567-e89b-12d3-a456-426614174000", "internationalization" * 3, "ABCDEFGHIJ0123456789abcdefghij"):
        assert secrets.scan(t) == [], t


def test_time_grows_with_the_text():
    rnd = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lines = [f"api_key = {''.join(rnd.choices(alphabet, k=32))} and {''.join(rnd.choices(alphabet, k=40))}" for _ in range(16_000)]
    letters = "A1b2" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))  # one run without a separator
    secrets.scan("\n".join(lines[:500]))
    for text in (lambda k: "\n".join(lines[:k]), lambda k: "".join(x[-40:] for x in lines[:k]), lambda k: letters[: 25 * k]):
        took = []
        for k in (2_000, 16_000):
            start = time.process_time()
            secrets.scan(text(k))
            took.append(time.process_time() - start)
        assert took[1] < 24 * took[0] + 1, took  # 64 times, were it the square


def test_spans_beside_many_base_spans_against_plain_search():
    rnd = random.Random(10)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(50):
        spans = sorted((a, a + rnd.randint(1, 30)) for a in rnd.sample(range(300), 12))
        start = rnd.randrange(300)
        end = start + rnd.randint(1, 60)
        free = [i for i in range(start, end) if not any(a <= i < b for a, b in spans)]
        got = secrets.uncovered(start, end, secrets.united(spans))
        assert [i for a, b in got for i in range(a, b)] == free and all(a < b for a, b in got)
    key = "".join(rnd.choices(alphabet, k=48))
    text = " ".join(f"token={'x' * 8} {key}" for _ in range(40))
    assert sum(k == "entropy_base64" for k, *_ in secrets.scan(text)) == 40
