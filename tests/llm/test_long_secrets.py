"""Secret scans of long candidate strings and of many matches."""

import math
import random
import time
from collections import Counter

from ledgerline.llm import secrets

KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def hot(value, bound):
    w = secrets.WINDOW
    at = [i for i in range(len(value) - w + 1) if round(-sum(n / w * math.log2(n / w) for n in Counter(value[i : i + w]).values()), 9) >= bound]
    return (at[0], at[-1] + w) if at else None


def _scan(make_docs, texts):
    begun = time.perf_counter()
    rows = {r.doc_id: r.spans for r in secrets.secret_report(make_docs(list(enumerate(texts)))).collect()}
    return [rows[i] for i in range(len(texts))], time.perf_counter() - begun


def test_windows_of_long_strings(make_docs):
    rng = random.Random(9)
    texts = []
    for k in range(40):
        text = "".join(rng.choices(KEYS[: rng.choice([2, 6, 12, 40, 62])], k=rng.randint(20, 300))) + "a1"
        texts.append(text + ("".join(rng.choices(KEYS, k=60)) if k % 3 == 0 else "") + "z" * rng.randint(0, 50) + "9")
    found, _ = _scan(make_docs, texts)
    for text, spans in zip(texts, found):
        want = hot(text, 3.4 if text.upper() == text else 3.7)
        got = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s.startswith("entropy")]
        assert got == ([want] if want else []), text


def test_a_million_characters(make_docs):
    rng = random.Random(1)
    texts = ["".join(rng.choices(KEYS, k=1_000_000)) + "a1", "Ab-" * 300_000 + "12345", "A" + "-" * 60 + "12345x", "x" + "-9" * 400_000]
    spans, seconds = _scan(make_docs, texts)
    assert spans[0].startswith("entropy:") and seconds < 120


def test_very_many_matches(make_docs):
    texts = ["password=abc123 " * 20_000, "token: x1 secret='abcdef' " * 500 + "AKIA" + "B" * 16]
    (many, few), seconds = _scan(make_docs, texts)
    assert many.split(",")[:2] == ["assign:0:15", "assign:16:31"] and many.split(",")[-1] == f"assign:{16 * 19_999}:{16 * 19_999 + 15}" and many.count(",") == 19_999
    assert few.count("assign") == 500 and few.endswith(f"access:{26 * 500}:{26 * 500 + 20}") and seconds < 120
