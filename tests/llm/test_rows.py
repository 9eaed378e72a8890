"""Mixing, packing, secrets, search and pages: brute force, round trips, odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from made import prose
from pyspark.sql import functions as F

from ledgerline.llm import mixing, packing, pages, search, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Water filling by bisection."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    share, low, high = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < share else (low, mid)
    return {s: min(2 * sizes[s], low * weight[s]) for s in names}


def test_mix(make_docs):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randint(0, 60)), rng.choice(["a", "b", "é", "Z", None])) for i in range(300)] + [(301, prose(9, 9000), "a"), (302, None, "b"), (303, "", "lone"), (304, "x", "lone")]
    rows += [(7, "same words here", "a")] * 5 + [(None, "no id", "b")] * 2
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    docs = make_docs(rows, clash=True)
    drawn = mixing.mix(docs, block_words=200, shard_blocks=4).collect()
    taken = {}
    for r in drawn:
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
        assert r["words"] <= r["size"] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert (r["shard"] is None) == (r["words"] == 0)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    places = {}
    for r in drawn:
        if r["shard"] is not None:
            places.setdefault(r["shard"], []).append(r["place"])
    assert len(places) > 5 and all(sorted(p) == list(range(len(p))) for p in places.values())
    got = sorted(map(str, mixing.amounts(docs, block_words=200, shard_blocks=4).collect()))
    assert len(got) == len(rows) and got == sorted(map(str, mixing.amounts(docs.repartition(5), block_words=200, shard_blocks=4).collect()))
    kept = mixing.mixed_rows(docs, block_words=200)
    assert kept.columns == docs.columns
    assert sum(size(r["text"]) for r in kept.collect()) == sum(taken.values())
    assert mixing.amounts(make_docs([])).count() == 0 and mixing.amounts(make_docs([(1, None), (2, " ")])).agg(F.sum("taken")).first()[0] == 0


def test_split_is_hypergeometric(session):
    k, n, t = 30, 40, 100
    u = session.range(20_000).select(mixing._hypergeometric(F.lit(k), F.lit(n), F.lit(t), mixing._uniform(F.col("id"))).alias("x"))
    got = {r["x"]: r["count"] / 20_000 for r in u.groupBy("x").count().collect()}
    pmf = {x: math.comb(k, x) * math.comb(t - k, n - x) / math.comb(t, n) for x in range(0, k + 1)}
    assert max(abs(got.get(x, 0) - p) for x, p in pmf.items()) < 0.012
    edge = session.range(1).select(*[mixing._hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.5)) for a, b, c in ((0, 3, 5), (5, 5, 5), (3, 0, 5), (4, 3, 5), (1, 1, 1))]).first()
    assert edge[0] == 0 and edge[1] == 5 and edge[2] == 0 and 2 <= edge[3] <= 3 and edge[4] == 1


def test_quotas_are_kept_whole(session):
    targets = session.createDataFrame([("a", 0, 10, 4000.0), ("b", 1, 10, 0.0), ("c", 2, 10, 777.0)], "source string, rank int, source_size long, target double")
    rows = mixing.shard_quotas(targets, 10, 8, 3).collect()
    for rank, blocks in ((0, 400), (1, 0), (2, 78)):
        assert sorted(r["position"] for r in rows if r["rank"] == rank) == list(range(blocks))
    assert len({r["shard"] for r in rows}) == math.ceil(478 / 8)


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def entropy_spans(t):
    out, w = [], secrets.WINDOW
    for m in re.finditer(secrets.CANDIDATE, t):
        s = m[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(a, s) for a in secrets.ALLOWED):
            continue
        bound = next(b for c, b in secrets.CLASSES if re.search(c, s))
        hot = [i for i in range(len(s) - w + 1) if -sum(s[i : i + w].count(c) / w * math.log2(s[i : i + w].count(c) / w) for c in set(s[i : i + w])) >= bound]
        if hot:
            out.append((m.start() + hot[0], 3, m.start() + hot[-1] + w))
    return out


def test_secrets(make_docs):
    rng = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
    key = lambda n, a=alphabet: "".join(rng.choice(a) for _ in range(n))
    texts = [
        "password = 'hunter2x' and Token:abcdef, apikey=ab api_key=\"abcdef", "token=token: abcdefgh", "secret=secret=abcdefg", "AKIA" + "A" * 16 + " XAKIAABC AKIA" + "B" * 15, "0123456789abcdef01234567 é 😀 0123456789ABCDEF0123",
        f"é😀 {key(40)} x", f"{key(32, '0123456789abcdef')}\n{key(24, 'ABCDEFGHJKLMNPQRSTUVWXYZ234567')}", "aaaaaaaaaaaaaaaaaaaaaaaa1", "https://a.example/path1/of-some_words2/that-are/plain", "550e8400-e29b-41d4-a716-446655440000", "your_key_" + key(30), key(21) * 3,
        None, "", " ", "x" * 200_000 + " token=" + key(30) + " " + key(5000), "ﬁtoken=ſecret PASSWD='" + key(9) + "'", "\n".join("password=" + key(20) for _ in range(300)),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    found = secrets.secret_report(make_docs(rows, clash=True)).collect()
    assert len(found) == len(rows)
    for r in found:
        t = texts[r["doc_id"] or 0] or ""
        base = base_spans(t)
        write = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)], t[:80]
        assert r["base_sha256"] == hashlib.sha256(write(base).encode()).hexdigest()
        assert r["spans"] == write(sorted(base + entropy_spans(t))), t[:80]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(make_docs([(i, t) for i, t in enumerate(texts)])).collect()}
    assert clean[2] == "[REDACTED]" and clean[12] is None and clean[13] == "" and "hunter2x" not in clean[0]
    assert not any(base_spans(t or "") for t in clean.values())
    assert secrets.secret_report(make_docs([])).count() == 0


def test_pack_lengths_fit_and_are_few():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 4097, 3000) ** 2 // 4096 + 1)[::-1]
    bins, offset = packing.pack_lengths(lengths, 4097)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offset[own])]
        assert (np.cumsum(lengths[own]) - lengths[own] == offset[own]).all() and lengths[own].sum() <= 4097
    assert len(np.unique(bins)) <= 1.02 * lengths.sum() / 4097  # the sum is a lower bound no packing need reach


def test_packing_round_trip(make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "  ", "a", "İstanbul ΣΑΣ x", "don't can't I'M it's 'S", "<|endoftext|> hi <|startoftext|>x", "a b c d", "é tést", "12 3.14 a1b2", "\x1c\x1dx y\x85z", "日本語 テスト", "ﬁ ẞ ÇA", "|||| --- *** %%% word%%%", prose(1, 9000), prose(2, 700)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, "a b")]
    found = packing.pack(make_docs(rows, clash=True), shard_pieces=6).collect()
    by_doc, sequences = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
        got = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]})
        assert got == want, t
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(make_docs([])).count() == 0


def test_search_is_exact(make_docs, session):
    rng = random.Random(4)
    words = ["w%d" % (i * i // 40) for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(1000 + i, "w1 w2 w3 w3") for i in range(30)] + [(2000, None), (2001, ""), (None, "w1 w9"), (2002, "W1 " * 20_000)]
    asked = [(1, "w1 W9 w20 w20"), (2, "w3 w2"), (3, None), (4, "nowhere"), (5, " ".join(words))]
    queries = session.createDataFrame(asked, "item_id long, text string")
    old = search.SHARD_DOCS
    search.SHARD_DOCS = 100
    try:
        got = [tuple(r) for r in search.search(make_docs(rows, clash=True).repartition(3), queries).collect()]
    finally:
        search.SHARD_DOCS = old
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    mean = sum(len(w) for _, w in docs) / len(docs)
    want = []
    for q, text in asked:
        scores = []
        for i, w in docs:
            s = 0.0
            for x in sorted(set((text or "").lower().split())):
                df = sum(x in v for _, v in docs)
                c = w.count(x)
                if c:
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s:
                scores.append((-round(s, 6), i if i is not None else 1 << 62, i))
        want += [(q, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:10])]
    assert sorted((q, r, i) for q, r, i, _ in got) == sorted((q, r, i) for q, r, i, _ in want)
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got, key=lambda x: x[:2]), sorted(want, key=lambda x: x[:2])))
    assert search.search(make_docs([]), queries).count() == 0 and search.search(make_docs(rows), queries.limit(0)).count() == 0


def test_blocks_that_cannot_win_are_passed_by():
    rng = np.random.default_rng(6)
    n = 64 * 200
    terms = [sorted({0} | set(rng.choice(np.arange(1, 40), 3).tolist())) for _ in range(n)]
    # Two rare words stand together in twelve documents only, one in each of the first blocks.
    for i in range(0, 64 * 12, 64):
        terms[i] = sorted({*terms[i], 40, 41})
    table = pa.table({"doc_id": np.arange(n), "length": rng.integers(5, 9, n), "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))})
    weight = np.array([0.01] + [1.0] * 39 + [6.0, 6.0])
    index = search._Index(table, weight, 7.0)
    own = [0, 3, 40, 41]
    got = index.best(own, 10)
    length = table.column("length").to_numpy()
    plain = sorted((-round(sum(weight[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length[i] / 7.0)) for t in own if t in terms[i]), 6), i) for i in range(n))[:10]
    assert [(i, round(-s, 5)) for s, i, _ in got] == [(i, round(-s, 5)) for s, i in plain]
    assert index.scored <= 12


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href=x>Home</a><li><a>About us</a></ul></nav><div class="cookie-notice">We use cookies &amp; more, accept them all please.</div>%s
<aside><h3>Related</h3><p>Some other story, long enough to look like prose, is it not, yes it is.</p></aside><section id="comments"><h2>Comments</h2>
<p>I think this is great and I enjoyed reading it very much, thank you.</p></section><form>Name <input> <button>Send</button></form><footer>© 2020 Site</footer></body>"""
BODY = '<h1>The title</h1><p>First paragraph with <b>bold</b>ness &eacute;t&#233; and words enough to look like prose.<p>Second\n  paragraph is here,<br>and goes on.<div class="ad">Buy now the best thing</div><!-- no --><p>Third one, short.</p>'
MAIN = "The title First paragraph with boldness été and words enough to look like prose. Second paragraph is here, and goes on. Third one, short."


@pytest.fixture(scope="module")
def page_table(session, sf):
    return session.read.parquet(f"{sf}/pages.parquet")


def test_pages(session, page_table):
    import html

    model = pages.train(page_table)
    rows = page_table.collect()

    def article(h):
        inside = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inside))).split())

    right = sum(pages.main_text(model, r["html"]) == article(r["html"]) for r in rows)
    assert right >= 0.95 * len(rows)
    for frame in ("<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>'):
        assert pages.main_text(model, PAGE % (frame % BODY)) == MAIN, frame
    odd = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<div>" * 20_000 + "deep"), (5, "u", "plain words only"), (5, "u", "&#xZZ; &nosuch; <b>x"), (6, "u", PAGE % (f"<article>{'<p>Long paragraph of words, again.</p>' * 5000}</article>"))]
    df = session.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = pages.extract(df, model).collect()
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got[:2]] == ["", ""]
    assert got[-1]["text"].count("Long paragraph") == 5000
    assert pages.extract(df.limit(0)).count() == 0


def test_a_worker_lets_go_of_what_another_operator_kept():
    from ledgerline.llm import common, packing

    first = packing.encoder(packing.VOCABULARY)
    common.make_room("packing")
    assert packing.encoder(packing.VOCABULARY) is first
    common.make_room("toxicity")
    assert packing.encoder.cache_info().currsize == 0 and packing.encoder(packing.VOCABULARY) is not first


def test_known_words_are_looked_up_once_and_odd_bytes_read_like_the_tokenizer():
    from ledgerline.llm.packing import VOCABULARY, WordEncoder

    class Counting(dict):
        looked = 0

        def get(self, *a):
            self.looked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.looked += 1
            return super().__getitem__(k)

    made = WordEncoder(VOCABULARY)
    odd = "Straße STRASSE, naïve! K Å K İx a b a\x85b x\x1cy (ab) ab) 'tis don't 12.5% \U0001f600 ￼ é́ ﻿".encode() + b" \xe2\x82 \xff\xfeab \xc3 end"
    for text in (odd, odd[::-1], b"", b" \n "):
        want = [i for w in text.split() for i in made.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids]
        assert made.encode([text])[0].tolist() == want
    made.known = Counting(made.known)
    made.encode([odd * 50 + b" onenewword"])
    # One look at every word, and a second one at those that were new.
    assert made.known.looked <= len((odd * 50 + b" onenewword").split()) + 60
