"""The trained operators on held-out rows, the field against enumeration, the pipeline."""

import itertools
import zlib

import numpy as np
import pytest
from made import CLASHING, prose
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import crf, quality, toxicity
from ledgerline.llm.common import held_out


@pytest.mark.parametrize("n", [1, 2, 9])
def test_marginals_and_viterbi_against_enumeration(n):
    rng = np.random.default_rng(n)
    score, cross = rng.normal(size=n) * 2, rng.normal(size=(2, 2)) * 2
    start = rng.random(n) < 0.3
    start[0] = True
    weight = {}
    for y in itertools.product((0, 1), repeat=n):
        weight[y] = sum(score[i] * y[i] for i in range(n)) + sum(cross[y[i - 1], y[i]] for i in range(1, n) if not start[i])
    total = sum(np.exp(w) for w in weight.values())
    want = [sum(np.exp(w) for y, w in weight.items() if y[i]) / total for i in range(n)]
    assert np.allclose(crf.marginals(score, start, cross), want)
    single = {y: sum(score[i] * y[i] for i in range(n)) + sum(cross[y[i - 1], y[i]] for i in range(1, n)) for y in weight}
    assert tuple(crf.viterbi(score.tolist(), cross.tolist())) == max(single, key=single.get)
    assert crf.viterbi([], cross.tolist()) == [] and len(crf.marginals(score[:0], start[:0], cross)) == 0


BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(session):
    return session.read.parquet(f"{BIG}/documents.parquet"), session.read.parquet(f"{BIG}/labels.parquet")


def judged(report, labels, label):
    rows = report.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").collect()
    return [r for r in rows if r["held_out"]], rows


def auc(rows):
    s, y = np.array([r["score"] for r in rows]), np.array([r["y"] for r in rows])
    return (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    held, rows = judged(toxicity.toxicity_report(docs, labels), labels, "toxic")
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    flagged = [r["y"] for r in held if r["predicted"]]
    assert auc(held) > 0.93 and np.mean(flagged) > 0.93 and sum(flagged) > 0.85 * sum(r["y"] for r in held)
    texts = dict(docs.select("doc_id", "text").collect())
    words = {texts[r["doc_id"]][int(a) : int(b)].lower() for r in rows if r["spans"] for a, b in (s.split(":") for s in r["spans"].split(","))}
    assert {"idiot", "moron", "worthless"} <= words and len(words) < 2000


def test_toxicity_when_the_lowest_ids_have_one_label(make_docs, session):
    rows = [(i, prose(i, 30), 0) for i in range(2500)] + [(i, prose(i, 15) + " you idiot moron " + prose(i + 9000, 15), 1) for i in range(2500, 2800)]
    docs, labels = make_docs([r[:2] for r in rows]), session.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity_report(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] >= 2500) for r in held]) > 0.98


def test_a_rare_label_late_in_the_sample_is_learnt():
    rows = [(i, prose(i, 30), 0) for i in range(600)] + [(i, prose(i, 30) + " idiot", 1) for i in range(600, 620)]
    model = toxicity.fit(rows, tagged=100)
    toxic, clean = toxicity.score_texts(model, [prose(7001, 30) + " idiot", prose(7002, 30)])[0]
    assert toxic > 0.5 > clean


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    held, _ = judged(quality.quality_report(docs, labels), labels, "quality")
    assert auc(held) > 0.99 and np.mean([r["predicted"] == r["y"] for r in held]) > 0.98


def test_interactions_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.95 and {0, 1} in [{i, j} for i, j, _ in model.pairs]


def odd_rows():
    return [(1, None), (2, ""), (3, " \n"), (4, "idiot " * 30_000), (5, "İdiot ﬁ x"), (5, "same"), (5, "same"), (None, "no id"), (7, prose(1, 30))]


@pytest.mark.parametrize("operator", [toxicity.toxicity_report, quality.quality_report])
def test_odd_rows_and_tables(make_docs, session, operator):
    docs = make_docs(odd_rows(), clash=True)
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 1)], [(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (7, None, None), (7, 5, 5), (7, 1, 0)]):
        got = operator(docs, session.createDataFrame(rows, schema)).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        same = {(r["score"], r["predicted"]) for r in got if r["doc_id"] == 5}
        assert len(same) <= 2
    assert operator(make_docs([]), session.createDataFrame([], schema)).count() == 0


def test_scores_do_not_hang_on_ids_or_held_out_labels(make_docs, session, tables):
    docs, labels = (t.where("doc_id < 1500") for t in tables)
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, x) for x in (labels, flipped))
    assert one.words == two.words and (one.calibration == two.calibration).all()


def test_pipeline(session):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few toxic rows to learn from
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "secret_scans", "mix_sources", "sum_of_squares_packing"]
    docs = session.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in CLASHING})
    rows = {0: {r["doc_id"]: r for r in docs.collect()}}
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(session, kept, sf).cache()
        if k < 4:
            assert kept.columns == docs.columns
        rows[k + 1] = kept.collect()
    texts = {k: [(r["doc_id"], r["text"]) for r in rows[k]] for k in range(1, 5)}
    slurs = ("idiot", "moron", "worthless", "pathetic")
    gone = set(rows[0]) - {i for i, _ in texts[1]}
    assert gone and all(t == rows[0][i]["text"] for i, t in texts[1])
    assert sum(any(s in rows[0][i]["text"].lower() for s in slurs) for i in gone) >= 0.5 * len(gone)
    from test_pairs import brute_components

    groups = brute_components(texts[1])
    assert sorted(i for i, _ in texts[2]) == sorted(i for i, (_, c) in groups.items() if i == c)
    from test_rows import base_spans

    assert [i for i, _ in sorted(texts[3])] == [i for i, _ in sorted(texts[2])]
    assert not any(base_spans(t) for _, t in texts[3]) and all(a == b for a, b in zip(sorted(texts[2]), sorted(texts[3])) if not base_spans(a[1]) and "[REDACTED]" not in b[1])
    size = lambda t: len(t.split())
    assert sum(size(t) for _, t in texts[4]) == pytest.approx(1.5 * sum(size(t) for _, t in texts[3]), rel=0.01)
    pieces = {(r["doc_id"]) for r in rows[5]}
    assert pieces == {i for i, _ in texts[4]}
    assert session.createDataFrame([], docs.schema).count() == 0


def test_pipeline_of_odd_rows(make_docs, session, sf):
    docs = make_docs(odd_rows() + [(8, prose(3, 50)), (8, prose(3, 50))])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(session, docs, sf)
    assert docs.where("doc_id = 8").count() >= 0
    empty = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(session, empty, sf)
    assert empty.count() == 0
