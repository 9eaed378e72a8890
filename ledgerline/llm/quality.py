"""A generalised additive model with pairwise interactions for text quality.

Cyclic boosting: round by round each feature in turn gets a shallow tree (three
cuts) fitted to the current residuals, added to its lookup table over the
feature's bins; then the strongest pairs of features get trees of two by two
cuts, added to tables over pairs of bins. A score is a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import binaries, held_out, map_batches, utf8
from ledgerline.llm.toxicity import labelled_sample

# At most so many labelled documents are learnt from, taken by a hash of their id.
SAMPLE = 12_000
THRESHOLD = 0.5
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 32, 60, 0.15, 8, 30

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("A") : ord("Z") + 1] = 3
_CLASSES[ord("0") : ord("9") + 1] = 4
_CLASSES[[ord(c) for c in ".,;:!?"]] = 5
_CLASSES[[ord(c) for c in "#$%&*|<>{}[]=+~^_\\/@"]] = 6
_CLASSES[0x80:0xC0] = 7  # later bytes of a character
_CLASSES[0xC0:] = 8
NAMES = [
    "words", "word_length", "upper", "digits", "stops", "symbols", "exclamations", "foreign", "distinct_words", "commonest_word", "repeated_next", "repeated_lines",
    "words_a_line", "symbol_words", "short_words", "longest_word", "upper_words", "lone_symbols", "line_share",
]
_SYMBOL_WORD = re.compile(rb"[A-Za-z\x80-\xff.,]+[#$%&*|<>{}=+~^!@]{2,}|[#$%&*|<>{}=+~^]{3,}")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers a text, from its whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, t in enumerate(texts):
        n = len(t)
        if not n:
            continue
        count = np.bincount(_CLASSES[np.frombuffer(t, np.uint8)], minlength=9)
        words = t.split()
        k = len(words)
        if not k:
            continue
        letters = max(1, count[2] + count[3] + count[8])
        chars = n - count[7]
        own = Counter(words)
        lines = [x for x in t.split(b"\n") if x.strip()]
        sizes = list(map(len, words))
        out[i] = (
            np.log1p(k), letters / k, count[3] / letters, count[4] / chars, count[5] / k, count[6] / chars, t.count(b"!") / k, count[8] / letters, len(own) / k**0.85, max(own.values()) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k, 1 - len(set(lines)) / len(lines), np.log1p(k / len(lines)), len(_SYMBOL_WORD.findall(t)) / k, sum(s <= 3 for s in sizes) / k,
            np.log1p(max(sizes)), sum(map(bytes.isupper, words)) / k, (own.get(b"|", 0) + own.get(b"-", 0) + own.get(b"*", 0)) / k, len(lines) / k,
        )
    return out


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: vectorised additions of bin entries."""
        b = self.bins(x)
        s = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            s += table[b[:, j]]
        for i, j, table in self.pairs:
            s += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of the bins [low, high) by sums of gradients and curvatures."""
    if high - low < 2:
        return 0.0, low
    a, b = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    total, weight = g[low:high].sum(), h[low:high].sum()
    gain = a**2 / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total**2 / (weight + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), low + at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value a bin of a tree of depth two."""
    out = np.zeros(len(g))
    gain, middle = _best_cut(g, h, 0, len(g))
    parts = [(0, middle), (middle, len(g))] if gain > 0 else [(0, len(g))]
    for low, high in parts:
        own, cut = _best_cut(g, h, low, high)
        for a, b in [(low, cut), (cut, high)] if own > 0 and gain > 0 else [(low, high)]:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best of a few two by two cuts of a table of sums."""
    best, out = 0.0, np.zeros(g.shape)
    cuts_a = {_best_cut(g.sum(axis=1), h.sum(axis=1), 0, g.shape[0])[1], *(g.shape[0] * q // 4 for q in (1, 2, 3))}
    cuts_b = {_best_cut(g.sum(axis=0), h.sum(axis=0), 0, g.shape[1])[1], *(g.shape[1] * q // 4 for q in (1, 2, 3))}
    for a in sorted(cuts_a):
        for b in sorted(cuts_b):
            quarters = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            sums = [(g[q].sum(), h[q].sum()) for q in quarters]
            gain = sum(x**2 / (y + 1) for x, y in sums)
            if gain > best:
                best, out = gain, np.zeros(g.shape)
                for q, (x, y) in zip(quarters, sums):
                    out[q] = x / (y + 1)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables; with one label only, a constant."""
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    widths = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(w) for w in widths]
    s = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, w in enumerate(widths):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, w), np.bincount(b[:, j], h, w))
            model.tables[j] += step
            s += step[b[:, j]]

    def table(i: int, j: int):
        g, h = slopes()
        at = b[:, i] * widths[j] + b[:, j]
        shape = (widths[i], widths[j])
        return _pair_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((table(i, j)[0], i, j) for i in range(len(widths)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((widths[i], widths[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, entries in model.pairs:
            step = RATE * table(i, j)[1]
            entries += step
            s += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The texts stay on the executors: only features of the bounded sample come to the driver."""
    sample = labelled_sample(docs.select("doc_id", utf8(F.col("text")).alias("text")), labels, "quality", ["text"], most).repartition(16, "doc_id")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(binaries(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = map_batches(sample, measured, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES))
    order = np.lexsort(x.T)
    return fit(x[order], np.array([r["label"] for r in rows], float)[order])


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null, empty and blank texts have features of zero and are scored as such;
    repeated rows score alike; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.value.score(features(binaries(batch.column("text"))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8(F.col("text")).alias("text"))
    return map_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int")
