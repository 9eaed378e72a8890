"""Near copies, repeated passages and vectors against brute force."""

import random

import numpy as np
import pytest
from made import prose
from pyspark.sql import functions as F

from ledgerline.llm import jaccard, near, paragraphs, shingles, vectors
from ledgerline.llm.components import components


def roots(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sets_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join("zz" + str(rng.randint(0, 9)) if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rows = []
    for g in range(12):
        base = prose(g, 30 + 25 * g)
        rows += [(100 * g + k, base if k < 2 else edited(base, k, 0.012 * k)) for k in range(8)]
    shared = prose(999, 70)
    rows += [(5000 + k, prose(2000 + k, 40 + k) + " " + shared + " " + prose(3000 + k, 50)) for k in range(40)]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one"), (9006, "é " * 3000), (9007, "É " * 3000), (9008, "word " * 30000)]
    return rows


def test_components_of_random_graphs(session):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(5, 5), (7, 3), (3, 7), (7, 3)]
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    want = roots(links + chain, range(1100))
    df = session.createDataFrame(links + chain + [(None, 4)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(df).collect()}
    linked = {x for a, b in links + chain if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(df.limit(0)).count() == 0


def brute_components(rows, percent=75):
    own = {i: sets_of(t) for i, t in rows}
    ids = sorted(own)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    return {i: (len(own[i]), r) for i, r in roots(links, ids).items()}


def test_jaccard_join_is_exact(make_docs, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(make_docs(corpus, clash=True)).collect()}
    assert got == brute_components(corpus)


def test_jaccard_join_in_small_tiles(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(near, "PAIRED", 2)
    monkeypatch.setattr(near, "TILE", 500)
    monkeypatch.setattr(near, "SENT_IDS", 0)
    # One band of one row: most pairs meet in tiles of a few frequent keys only.
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(make_docs(corpus), bands=24, rows=1).collect()}
    assert got == {i: c for i, (_, c) in brute_components(corpus).items()}


@pytest.mark.parametrize("tile", [near.TILE, 300])
def test_tiles_lose_no_component(session, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = random.Random(8)
    universe = [rng.getrandbits(64) for _ in range(400)]
    members = []
    for i in range(120):
        own = np.array(sorted(rng.sample(universe[: 60 + 2 * (i % 40)], 40 + i % 25)), np.uint64)
        members.append((7, i, i - i % 3 if i % 2 else i, len(own), bytearray(shingles.bitmap(own)), bytearray(own.tobytes()), own))
    df = session.createDataFrame([m[:6] for m in members], "key long, id long, root long, n long, bits binary, own binary")
    got = [(r["a"], r["b"]) for r in near.tile_links(df, 75).collect()]
    before = [(m[1], m[2]) for m in members]
    want = [(a[1], b[1]) for a in members for b in members if a[1] < b[1] and shingles.links(a[3], b[3], shingles.shared_count(a[6], b[6]), 75)]
    assert want and set(map(tuple, map(sorted, got))) <= set(want)
    assert roots(before + got, range(120)) == roots(before + want, range(120))


def test_jaccard_join_of_odd_tables(make_docs):
    rows = [(None, prose(1, 40)), (1, prose(1, 40)), (1, prose(1, 40)), (1, prose(2, 40)), (None, None), (2, prose(2, 40))]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (1, 1), (1, 1), (1, 1), (2, 1)], key=str)
    empty = jaccard.near_duplicates(make_docs([]))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_shingles_of_long_texts_cross_segments():
    text = prose(4, 300_000)
    own = shingles.shingle_sets([b"", text.encode(), b"a b c d e"])
    assert len(own[0]) == 0 and len(own[2]) == 1
    assert len(own[1]) == len(sets_of(text))
    assert (shingles.shingle_sets([text.upper().encode()])[0] == own[1]).all()


def test_repeated_passages(make_docs):
    shared, near_line = prose(50, 60), prose(51, 60)
    rows = [(k, prose(600 + k, 80) + " " + shared + " " + prose(700 + k, 80)) for k in range(6)]
    # One word of sixty changed: 51 of 61 shingles are shared with the first one, fewer between the changed ones.
    changed = [near_line.split() for _ in range(3)]
    changed[1][20] = changed[2][40] = "zz"
    rows += [(20 + k, prose(800 + k, 40) + "\n" + " ".join(changed[k]) + "\n" + prose(850 + k, 40)) for k in range(3)]
    clean = [(40 + k, prose(900 + k, 150)) for k in range(10)]
    odd = [(60, None), (61, ""), (62, "\n\n \n"), (63, "short line\nshort line"), (None, prose(600, 80)), (64, prose(77, 30) + "\n" + prose(77, 30))]
    found = paragraphs.repeated_passages(make_docs(rows + clean + odd, clash=True)).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(range(6)) <= set(by_doc) and not set(by_doc) & {i for i, _ in clean + odd}
    assert {20, 21, 22} <= set(by_doc)
    text = dict(rows)
    for i in range(6):
        r = max(by_doc[i], key=lambda x: x["n_words"])
        words = text[i].split()[r["first_word"] : r["first_word"] + r["n_words"]]
        assert r["n_words"] >= 30 and " ".join(words) in shared
        assert r["first_doc"] == 0 and r["kept"] == (i == 0)
    assert paragraphs.repeated_passages(make_docs([])).count() == 0


def test_what_repeats_is_kept_in_its_first_document(make_docs):
    head, p, q = prose(61, 20), prose(62, 40), prose(63, 40)
    body = [prose(64 + k, 30) for k in range(3)]
    variant = p.split()
    variant[20] = "zz"
    variant, other = " ".join(variant), prose(75, 30)
    rows = {
        1: f"{head}\n{prose(71, 30)}", 5: "\n".join([head, *body]), 9: "\n".join([head, *body]),  # copies whose first line is older
        11: p, 12: f"{p}\n{q}", 13: q,
        # A near copy of a line, with a changed part that comes again in another line.
        14: f"{prose(76, 30)}\n{variant}", 15: f"{other} {' '.join(variant.split()[8:36])} {prose(77, 30)}", 16: f"{prose(78, 30)}\n{variant}",
    }
    found = paragraphs.repeated_passages(make_docs(list(rows.items()))).collect()
    left = {d: t.split() for d, t in rows.items()}
    for r in found:
        assert r["kept"] == (r["doc_id"] == r["first_doc"]) and r["first_doc"] <= r["doc_id"]
        if not r["kept"]:
            assert None not in left[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]  # parts share no word
            left[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]] = [None] * r["n_words"]
    whole = {d: " ".join(w or "|" for w in ws) for d, ws in left.items()}
    for text in (head, *body, p, q):
        assert sum(text in t for t in whole.values()) == 1, text[:40]
    assert head in whole[1] and all(b in whole[5] for b in body) and p in whole[11] and q in whole[12]
    # Each five words of any text are left somewhere, but for those of the near copy's changed word.
    there = {g for t in whole.values() for g in sets_of(t.replace("|", ""))}
    lost = {g for t in rows.values() for line in t.split("\n") for g in sets_of(line)} - there
    assert all(b"zz" in g for g in lost), lost


def test_pieces_are_cut_alike_anywhere():
    core = prose(5, 60)
    a, b = (f"{prose(s, 30)} {core} {prose(s + 1, 30)}".encode() for s in (10, 20))

    def pieces(t):
        words, text = shingles.word_hashes([t])
        at = np.flatnonzero(paragraphs.cuts(words, text))
        plain = t.split()
        return {b" ".join(plain[x:y]) for x, y in zip(at, at[1:])}

    both = pieces(a) & pieces(b)
    assert sum(len(p.split()) for p in both) >= paragraphs.MIN_WORDS


def brute_vectors(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    ids = [i for i, _ in rows]
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links.append((a, b))
    degree = {i: 0 for i in ids}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return links, degree, roots(links, ids)


@pytest.mark.parametrize("tile", [vectors.TILE, 7])
def test_vectors(session, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = rng.standard_normal(16)
        rows += [(10 * g + k, (base + 0.12 * k * rng.standard_normal(16)).tolist()) for k in range(5)]
    copy = rng.standard_normal(16).tolist()
    rows += [(2000 + k, copy) for k in range(30)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] * 8), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [3.0])]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, leaf=32).collect()}
    links, degree, root = brute_vectors(rows)
    assert len(got) == len(rows)
    total = sum(degree.values())
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * total <= found <= total
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    assert sum(got[i]["component_id"] == root[i] for i in got) >= 0.98 * len(rows)
    assert all(got[2000 + k]["n_links"] == 29 and got[2000 + k]["component_id"] == 2000 for k in range(30))
    assert got[3007]["component_id"] == 3006 and got[3006]["kept"] and not got[3007]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(3000, 3006))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_below_the_sample_depth_are_found():
    rng = np.random.default_rng(5)
    n, size = 4000, 64
    a = vectors.unit(rng.standard_normal((n, size)))
    b = rng.standard_normal((n, size))
    b = vectors.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    total = vectors.LEAF << 16  # 10 levels learnt at most, as many as 16 are needed
    sample = vectors.unit(rng.standard_normal((4096, size)))
    met = np.zeros(n, bool)
    for t in range(vectors.trees_for(total)):
        tree = vectors.grow(sample, total, 100 + t)
        assert len(tree.lower) >= 6
        (r, x), (s, y) = tree.leaves(a), tree.leaves(b)
        met[np.intersect1d((r << 32) + x, (s << 32) + y) >> 32] = True
    assert met.mean() > 0.99, met.mean()
    assert vectors.trees_for(vectors.LEAF << 10) == vectors.trees_for(5) == vectors.TREES
