"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark documents, so tokens are labelled from them: over one half of the
sample, words and word beginnings are weighed by how much oftener they occur in
toxic documents; in the other half, a token of a toxic document with strong
evidence is a toxic one. On that half the field learns what the evidence bins
and their neighbours mean. Forward-backward marginals of every token of a text
give its spans, and two sums of them its score, calibrated on the labels.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import crf
from ledgerline.llm.common import held_out, map_batches, tidy

# At most so many labelled documents are learnt from, taken by a hash of their id.
SAMPLE = 8_000
THRESHOLD = 0.7
# Of these, so many are also tagged to fit the field, again by the hash; of a rarer label an eighth of it, if there are so many.
TAGGED = 1_200
_TOKEN = re.compile(r"\w+")
_PREFIXES, HEAD = (7, 6, 5), 5
_BINS = np.array([0.7, 1.4, 2.1, 2.8, 3.5, 4.2])
# Features: none, then one a bin of words, then of word beginnings.
_N = 1 + 2 * (len(_BINS) + 1)


@dataclass
class Model:
    words: dict[str, float]
    prefixes: dict[str, float]
    cross: np.ndarray
    rest: float
    calibration: np.ndarray  # of 1, the logit of the largest marginal, the log of their sum

    def __post_init__(self):
        self.heads = {w[:HEAD] for w in chain(self.words, self.prefixes)}

    def score(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.prefixes[word[:k]] for k in _PREFIXES if word[:k] in self.prefixes and len(word) >= k), default=self.rest)


def tokens(text: str) -> list[str]:
    """Lower-cased words; lower-casing must not move any place in the text."""
    lower = text.lower()
    return _TOKEN.findall(lower) if len(lower) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


def _evidence(counts: Counter, clean: Counter, n_toxic: int, n_clean: int, least: int) -> dict[str, int]:
    """Bin of the log ratio of document shares, for what is commoner in toxic documents."""
    out = {}
    for w, k in counts.items():
        if k >= least:
            ratio = np.log((k + 0.1) / (n_toxic + 1)) - np.log((clean[w] + 0.6) / (n_clean + 1))
            if ratio >= _BINS[0]:
                out[w] = int(np.searchsorted(_BINS, ratio, side="right"))
    return out


def _feature(word: str, words: dict, prefixes: dict) -> int:
    """One feature a token: its word's bin, else the strongest of its beginnings, else none."""
    if word in words:
        return words[word]
    best = max((prefixes.get(word[:k], 0) for k in _PREFIXES if len(word) >= k), default=0)
    return len(_BINS) + 1 + best if best else 0


class _Counts:
    """Documents of either label, in all and by word and word beginning."""

    def __init__(self):
        self.n, self.words, self.prefixes = [0, 0], (Counter(), Counter()), (Counter(), Counter())

    def add(self, toks: list[str], y: int):
        own = set(toks)
        self.n[y] += 1
        self.words[y].update(own)
        self.prefixes[y].update({w[:k] for w in own for k in _PREFIXES if len(w) >= k})

    def merge(self, other: _Counts):
        for y in (0, 1):
            self.n[y] += other.n[y]
            self.words[y].update(other.words[y])
            self.prefixes[y].update(other.prefixes[y])

    def lexicon(self) -> tuple[dict[str, int], dict[str, int]]:
        (clean, toxic), (p_clean, p_toxic) = self.words, self.prefixes
        return _evidence(toxic, clean, self.n[1], self.n[0], 3), _evidence(p_toxic, p_clean, self.n[1], self.n[0], 6)


def fit(rows: Iterable[tuple[int, str, int]], tagged: int = TAGGED) -> Model:
    """The model from (doc_id, text, toxic) rows in random order; without both labels it scores every text alike.

    Tokens are kept of the documents that are tagged only, of the others counts:
    of the first `tagged` rows, and beyond them of the first of a label until it
    has an eighth of that. The calibration weighs the labels as all rows have them.
    """
    counts, halves = (_Counts(), _Counts()), ([], [])
    usable = ((t or "", int(y)) for _, t, y in rows if y is not None)
    seen, kept = [0, 0], [0, 0]
    for k, (t, y) in enumerate(usable):
        toks, half = tokens(t), (seen[y] + y) % 2  # each label is dealt to both halves
        seen[y] += 1
        counts[half].add(toks, y)
        if k < tagged or kept[y] < max(2, tagged // 8):
            kept[y] += 1
            halves[half].append((toks, y))
    lexica = [c.lexicon() for c in counts]
    # Each half is read with the other's evidence, so the field does not trust what it has seen itself.
    feats, label, start, docs = [], [], [], []
    for half, (words, prefixes) in zip(halves, lexica[::-1]):
        known: dict[str, int] = {}
        for toks, y in half:
            for w in toks:
                if w not in known:
                    known[w] = _feature(w, words, prefixes)
            f = np.array([known[w] for w in toks], np.int64)
            feats.append(f)
            strong = ((f > 3) & (f <= len(_BINS) + 1)) | (f > len(_BINS) + 4)
            label.append((strong & bool(y)).astype(np.int64))
            s = np.zeros(len(f), bool)
            s[:1] = True
            start.append(s)
            docs.append((len(f), y))
    f, lab, st = (np.concatenate([np.zeros(0, k), *x]) for x, k in ((feats, np.int64), (label, np.int64), (start, bool)))
    positive = sum(y for _, y in docs)
    if not len(f) or not positive or positive == len(docs):
        return Model({}, {}, np.zeros((2, 2)), -9.0, np.array([-2.2, 0.0, 0.0]))
    chosen = crf.fit(f, np.arange(len(f) + 1), st, lab, _N)
    p = crf.marginals(chosen.weights[f], st, chosen.cross)
    sizes = np.array([n for n, _ in docs])
    x = _summary(p, np.concatenate([[0], np.cumsum(sizes)]))
    y = np.array([y for _, y in docs])
    share = np.array(seen) / sum(seen) * len(docs) / np.bincount(y, minlength=2)
    calibration = _logistic(x, y.astype(float), share[y])
    counts[0].merge(counts[1])
    words, prefixes = counts[0].lexicon()
    score = chosen.weights
    return Model(
        {w: float(score[b]) for w, b in words.items()},
        {w: float(score[len(_BINS) + 1 + b]) for w, b in prefixes.items()},
        chosen.cross,
        float(score[0]),
        calibration,
    )


def _summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: 1, the logit of the largest marginal, the log of one plus their sum."""
    sums = np.concatenate([[0.0], np.cumsum(p)])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    most = np.zeros(len(bounds) - 1)
    some = np.diff(bounds) > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, bounds[:-1][some])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log1p(np.maximum(total, 0))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score and toxic spans (code points, end exclusive) of each text."""
    toks = [tokens(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int64)
    flat = list(chain.from_iterable(toks))
    # Most words share their first letters with nothing the model knows and score alike.
    score = np.full(len(flat), model.rest)
    for i in np.flatnonzero(np.fromiter(map(model.heads.__contains__, [w[:HEAD] for w in flat]), bool, len(flat))):
        score[i] = model.score(flat[i])
    start = np.zeros(len(flat), bool)
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    p = crf.marginals(score, start, model.cross)
    x = _summary(p, bounds) @ model.calibration
    hits = np.flatnonzero(p >= 0.5)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d in np.unique(np.searchsorted(bounds, hits, side="right") - 1):
        own = set((hits[(hits >= bounds[d]) & (hits < bounds[d + 1])] - bounds[d]).tolist())
        spans[d] = [m.span() for i, m in enumerate(_TOKEN.finditer(texts[d])) if i in own]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), spans


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled rows of `docs` that may be learnt from, by a hash of the id; the id list is sent to the rows.

    Null and other labels than 0 and 1, null ids and ids without a document are left out; of repeated labels the largest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    once = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in columns]).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, tagged: int = TAGGED) -> Model:
    """Fitted in one task over the bounded sample, in the order of a hash of the id: the driver gets the model only."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, tagged))], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, "toxic", ["text"], most).coalesce(1)
    sample = sample.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = sample.mapInArrow(tidy(learn), "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([])


def score_documents(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "toxicity", spans_column: str = "toxic_spans") -> DataFrame:
    """`docs` with a score from 0 to 1 and the toxic spans as 'start:end', comma-joined.

    Null and empty texts score as texts without words and have no spans; whole
    texts are read; every row keeps its place. Input columns named like the new
    ones are replaced.
    """
    kept = docs.drop(score_column, spans_column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, spans = score_texts(packed.value, [t or "" for t in batch.column(text_column).to_pylist()])
        written = [",".join(f"{a}:{b}" for a, b in x) for x in spans]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(written, pa.string())], [*batch.schema.names, score_column, spans_column])

    return map_batches(kept, score, f"{schema}, `{score_column}` double, `{spans_column}` string")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels), score_column="score", spans_column="spans")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
