"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from made import prose

from ledgerline.llm import runs


def brute(words):
    """All runs of one list of words: every lag, smallest periods only."""
    w = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    found = []
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])
        step = np.diff(same)
        for s, e in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) + q).tolist()):
            if e - s >= max(24, 3 * q) and not any((w[s : e - p] == w[s + p : e]).all() for p in range(1, q)):
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n_},{q}\n" for s, n_, q in found), kept)]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def some(words, times, cut=0):
    return (" ".join(words) + " ") * times + " ".join(words[:cut])


def test_every_run_of_made_texts(make_docs):
    rng = random.Random(3)
    texts = []
    for k in range(60):
        q = rng.randint(1, 120)
        few = rng.choice([2, 5, 1000])
        words = [f"w{rng.randrange(few)}" for _ in range(q)]
        texts.append(f"{prose(k, rng.randint(0, 40))} {some(words, rng.randint(2, 6), rng.randint(0, q))} {prose(k + 99, rng.randint(0, 40))}")
    # Nested: a run whose period holds runs itself; two runs of one period side by side; Fibonacci words.
    inner = some([f"i{k}" for k in range(9)], 4).split()
    texts.append(some([*inner, *"x y z".split()], 4))
    texts.append(some([f"a{k}" for k in range(10)], 3) + some([f"b{k}" for k in range(10)], 3))
    a, b = ["a"], ["a", "b"]
    for _ in range(12):
        a, b = b, b + a
    texts.append(" ".join(b))
    texts.append("one " * 5000)
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r) for r in runs.run_report(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(i, t), i


def test_odd_rows(make_docs):
    long = some([f"q{k}" for k in range(70_000)], 3, 11) + " end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "x " * 30), (4, "x " * 30), (5, "x x " * 23), (-20, "é è " * 12), (7, long)]
    for clash in (False, True):
        docs = make_docs(rows, clash)
        got = sorted(map(tuple, runs.run_report(docs).collect()), key=repr)
        want = [expected(i, t) for i, t in rows[:-1]]
        assert [g for g in got if g[0] != 7] == sorted(want, key=repr)
        big = next(g for g in got if g[0] == 7)
        assert zlib.crc32(b"7") % 10 != 0 and big[1:6] == (1, 0, 210_011, 70_000, 3000)
    assert runs.run_report(make_docs([])).count() == 0


def test_the_operator_returns_runs_and_text(make_docs):
    row = runs.collapse_runs(make_docs([(1, "start " + "a b c " * 10 + "stop")])).first()
    assert (row.run_starts, row.run_lengths, row.run_periods, row.collapsed) == ([1], [30], [3], b"start a b c stop")


@pytest.mark.parametrize("least,periods", [(24, 3)])
def test_whole_table(session, sf, least, periods):
    docs = session.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in runs.run_report(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id
