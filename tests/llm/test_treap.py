"""Ranked search on treaps against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from made import CLASHING
from pyspark.sql import functions as F

from ledgerline.llm import treap


def terms(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=50):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for k, (i, c, size) in enumerate(own):
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("beam", [1, 32])
def test_a_treap_finds_the_best_columns(beam):
    rng = np.random.default_rng(4)
    for rows, columns, share in ((1, 1, 1), (3, 100, 0.5), (200, 37, 0.1), (40, 300, 0.02)):
        grid = rng.integers(1, 50, (rows, columns)) * (rng.random((rows, columns)) < share)
        at = np.nonzero(grid)
        made = treap.Treap.of(at[0], at[1], grid[at])
        for made_ in (made, treap.Treap.read(made.levels, *made.written())):
            assert made_.marks.tolist() == made.marks.tolist() and made_.peaks.tolist() == made.peaks.tolist()
            for _ in range(20):
                own = np.unique(rng.integers(0, rows, 5))
                weights = rng.integers(1, 5, len(own))
                sums = (grid[own] * weights[:, None]).sum(axis=0)
                want = [(c, sums[c]) for c in np.lexsort((np.arange(columns), -sums)) if sums[c] > 0][:7]
                assert list(zip(*(x.tolist() for x in made_.best(own, weights, 7, beam)))) == [(int(c), int(s)) for c, s in want]


def test_odd_rows(session, make_docs, monkeypatch):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "d3lta", "éta", "ΑΒΓ", "x", "don't", "a-b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(200 + i, "same text twice") for i in range(120)]  # ties beyond the limit
    docs += [(500, None), (501, ""), (502, " \t.,"), (None, "beta beta"), (7, "beta GAMMA"), (600, "beta\x00gamma\x7fx" * 20_000)]
    items = [(1, "beta BETA alpha"), (2, "éta αβγ ΑΒΓ d3lta"), (3, None), (4, "..."), (5, "nowhere"), (6, "same TEXT"), (None, "gamma"), (8, "beta"), (8, "x don"), (9, "a b t don x same")]
    asked = session.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(treap.ranked(make_docs(docs), asked)) == want
    clash = {c: F.lit("x") for c in [*CLASHING, "terms", "docs", "held", "rank", "block", "weight"]}
    monkeypatch.setattr(treap, "SHARD_DOCS", 20)
    monkeypatch.setattr(treap, "ITEM_BLOCK", 3)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        assert got(treap.ranked(make_docs(docs, True).repartition(3), asked.withColumns(clash))) == want
    finally:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    empty = make_docs([])
    assert got(treap.ranked(empty, asked)) == [] and got(treap.ranked(make_docs(docs), asked.limit(0))) == []
    assert got(treap.ranked(make_docs([(1, None), (2, "  ")]), asked)) == []


def test_only_a_part_of_the_cells_is_visited():
    """Ranges that cannot reach the best are not split."""
    rng = np.random.default_rng(1)
    n = 4096
    rows, columns = np.repeat(np.arange(8), n), np.tile(np.arange(n), 8)
    values = rng.integers(1, 10, 8 * n)
    values[(columns >= 100) & (columns < 110)] = 500
    made = treap.Treap.of(rows, columns, values)
    seen = []
    made.marks = made.marks.view(type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: (seen.append(np.size(k)), np.asarray(s)[k])[1]}))
    assert made.best(np.arange(8), np.ones(8, np.int64), 10, 32)[0].tolist() == list(range(100, 110))
    assert sum(seen) < len(values) / 8


def test_writers_and_readers_hold_one_shard_at_a_time(session, make_docs, monkeypatch):
    import pyarrow.parquet as pq

    from ledgerline.session import staged

    kept = {}

    def stage(df, label, **options):
        kept[label] = staged(df, label, **options)
        return kept[label]

    monkeypatch.setattr(treap, "staged", stage)
    monkeypatch.setattr(treap, "SHARD_DOCS", 16)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["ka", "lo", "mi", "ter", "un"], k=12))) for i in range(128)]
    items = [(1, "ka ter"), (2, "nowhere")]
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = got(treap.ranked(make_docs(docs).coalesce(1), session.createDataFrame(items, "item_id long, text string")))
    finally:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert found == brute(docs, items)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept["treaps"].inputFiles()]
    assert sum(f.num_rows for f in files) >= 8 and all(f.num_row_groups == f.num_rows for f in files)


def test_a_shard_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    shard = treap._Shard()
    for i in range(600):
        shard.add(i, b" ".join(b"w%d" % w for w in (60_000 * rng.random(500) ** 3).astype(int)))
    made = shard.row(600, shard.size)
    levels, marks, drops = (made.column(c)[0].as_py() for c in ("levels", "marks", "drops"))
    tracemalloc.start()
    cells = len(treap.Treap.read(levels, marks, drops).marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Read at up to 22 bytes a cell and written in 4.7 before.
    assert peak < 18 * cells and len(marks) + len(drops) < 2 * cells
