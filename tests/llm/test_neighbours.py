"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import neighbours
from made import CLASHING

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, top=20):
    """(query_id, rank, vec_id, score) by comparing everything; `rows` (id, vector), valid ones only, each id once."""
    out = []
    for q, v in rows:
        if q % 20:
            continue
        own = [(-float(np.cumsum(np.array(v, float) * np.array(w, float))[-1]), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(own)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def some(n, d=16, seed=1, scale=False):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if scale:
        v *= rng.uniform(0.1, 3, (n, 1))
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_one_cell_is_exact(session):
    rows = some(300, scale=True)
    assert rows_of(neighbours.nearest(session.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("scale", [False, True])
@pytest.mark.parametrize("cell,probes", [(200, 40), (12, 40)])
def test_cells_reach_the_recall(session, scale, cell, probes):
    """Small cells, so that one and two polytopes are used; probing every cell finds everything."""
    rows = some(3000, scale=scale)
    df = session.createDataFrame(rows, SCHEMA)
    assert (neighbours.CrossPolytopes(16, 1.0, 3000, cell=cell, even=not scale).second > 0) == (cell == 12)
    found = neighbours.nearest(df, cell=cell, probes=probes, share=0.2)
    got, want = rows_of(found), brute(rows)
    by_pair = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(want)
    hit = [(q, i, s) for q, _, i, s in got if (q, i) in by_pair]
    assert all(by_pair[q, i] == s for q, i, s in hit)
    assert len(hit) / len(want) >= 0.9 and abs(neighbours.recall(df, found) - len(hit) / len(want)) < 1e-9
    full = neighbours.CrossPolytopes(16, 1.0, 3000, cell=cell, even=not scale).cells
    assert rows_of(neighbours.nearest(df, cell=cell, probes=full, tables=1)) == want


def test_too_few_in_the_cells_means_all_vectors(session):
    rows = some(120)
    assert rows_of(neighbours.nearest(session.createDataFrame(rows, SCHEMA), cell=10, probes=1, tables=1)) == brute(rows)


def test_copies_and_ties(session, monkeypatch):
    """A third of all rows are one vector, slices and salts are small."""
    monkeypatch.setattr(neighbours, "ROW_TILE", 16)
    monkeypatch.setattr(neighbours, "QUERY_TILE", 4)
    monkeypatch.setattr(neighbours, "SALTED", 3)
    base = some(200)
    rows = [(i, base[0][1] if i % 3 == 0 else base[i % 50][1]) for i in range(600)]
    assert rows_of(neighbours.nearest(session.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert rows_of(neighbours.nearest(session.createDataFrame(rows, SCHEMA), cell=20, probes=64)) == brute(rows)


def test_odd_rows(session):
    good = some(30, 4) + [(40, [1.0, 2.0]), (41, [2.0, 1.0]), (60, [5.0]), (-20, [1.0, 0.0, 0.0, 0.0])]
    bad = [(80, None), (100, []), (120, [0.0] * 4), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [float("inf"), 1.0, 1.0, 1.0]), (180, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = session.createDataFrame(good + bad + [good[0], good[7]], SCHEMA)
    for frame in (df, df.withColumns({c: F.lit("x") for c in [*CLASHING, "rank", "v", "cell", "x", "y", "least"]})):
        assert rows_of(neighbours.nearest(frame)) == brute(good)
    assert neighbours.nearest(session.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(session.createDataFrame(bad, SCHEMA)).count() == 0
    assert rows_of(neighbours.nearest(session.createDataFrame([(0, [1.0, 1.0]), (0, [1.0, -1.0]), (7, [2.0, 0.0])], SCHEMA))) == [(0, 1, 7, 2.0), (0, 1, 7, 2.0)]


def test_whole_table(session, sf):
    vectors = session.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got, want = rows_of(neighbours.nearest(vectors)), brute(rows)
    assert len(got) == len(want) and sum((q, i) in {(a, c) for a, _, c, _ in want} for q, _, i, _ in got) / len(want) >= 0.9
