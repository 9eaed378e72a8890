"""A linear-chain conditional random field with two labels, in numpy.

Positions of many sequences lie end to end; `start` marks the first of each.
A position has the numbers of its features; the score of label 1 is the sum of
their weights (label 0 scores nothing), and `cross[a, b]` scores label b after
label a. Sums over label sequences run over the whole array at once: it is cut
into strips of equal length, the 2x2 products of each strip are formed side by
side, strips are chained, and each strip is run again from its first message.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # one a feature
    cross: np.ndarray  # 2 x 2

    def emission(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Score of label 1 per position; features of position i are features[bounds[i]:bounds[i + 1]]."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[features])])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _messages(score: np.ndarray, start: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Normalised forward messages (n, 2): belief in the label of each position, given what lies before and at it.

    Label 1 has the odds exp(score); a start forgets what came before.
    """
    n = len(score)
    width = max(1, int(np.sqrt(n)))
    strips = -(-n // width)
    pad = strips * width - n
    # One row a step: step t of every strip side by side.
    s = np.ascontiguousarray(np.concatenate([score, np.zeros(pad)]).reshape(strips, width).T)
    reset = np.ascontiguousarray(np.concatenate([start, np.ones(pad, bool)]).reshape(strips, width).T)
    e1 = 1.0 / (1.0 + np.exp(-np.clip(s, -50, 50)))
    e0 = 1.0 - e1
    (k00, k01), (k10, k11) = np.exp(cross - cross.max())
    # Products of a strip, from each of the two labels before it: p_ab goes from a to b.
    p00, p11 = np.ones(strips), np.ones(strips)
    p01, p10 = np.zeros(strips), np.zeros(strips)
    for t in range(width):
        r, lo, hi = reset[t], e0[t], e1[t]
        h0, h1 = 0.5 * (p00 + p01), 0.5 * (p10 + p11)
        p00, p01 = np.where(r, h0, p00 * k00 + p01 * k10) * lo, np.where(r, h0, p00 * k01 + p01 * k11) * hi
        p10, p11 = np.where(r, h1, p10 * k00 + p11 * k10) * lo, np.where(r, h1, p10 * k01 + p11 * k11) * hi
        norm = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / norm, p01 / norm, p10 / norm, p11 / norm
    m0, m1 = np.empty(strips), np.empty(strips)
    x, y = 0.5, 0.5
    for i, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist())):
        m0[i], m1[i] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.empty((width, strips))
    for t in range(width):
        r = reset[t]
        m0, m1 = np.where(r, 0.5, m0 * k00 + m1 * k10) * e0[t], np.where(r, 0.5, m0 * k01 + m1 * k11) * e1[t]
        m1 = m1 / (m0 + m1)
        m0 = 1.0 - m1
        out[t] = m1
    last = out.T.reshape(-1)[:n]
    return np.stack([1.0 - last, last], axis=1)


def _backward(score: np.ndarray, start: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Belief in the label of each position, given what lies at and after it."""
    ends = np.concatenate([start[1:], [True]]) if len(start) else start
    return _messages(score[::-1], ends[::-1], cross.T)[::-1]


def marginals(score: np.ndarray, start: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Probability of label 1 at every position (forward-backward)."""
    if not len(score):
        return np.zeros(0)
    return _meet(score, _messages(score, start, cross), _backward(score, start, cross))


def _meet(score: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    e1 = 1.0 / (1.0 + np.exp(-np.clip(score, -50, 50)))
    both = forward * backward / np.stack([1.0 - e1, e1], axis=-1)  # the position itself counts once
    return both[:, 1] / both.sum(axis=1)


def _pairs(forward: np.ndarray, backward: np.ndarray, start: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring labels."""
    joint = forward[:-1, :, None] * np.exp(cross)[None] * backward[1:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return joint[~start[1:]].sum(axis=0)


def fit(features: np.ndarray, bounds: np.ndarray, start: np.ndarray, label: np.ndarray, n_features: int, rounds: int = 80, ridge: float = 1.0) -> Crf:
    """Maximum penalised likelihood by gradient steps of adapted size (Adam)."""
    crf = Crf(np.zeros(n_features), np.zeros((2, 2)))
    owner = np.repeat(np.arange(len(label)), np.diff(bounds))
    seen = np.bincount(features, weights=label[owner].astype(float), minlength=n_features)
    inner = ~start[1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (label[:-1][inner], label[1:][inner]), 1.0)
    n = max(1, len(label))
    m, v = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for i in range(1, rounds + 1):
        score = crf.emission(features, bounds)
        forward, backward = _messages(score, start, crf.cross), _backward(score, start, crf.cross)
        p = _meet(score, forward, backward)
        expected = np.bincount(features, weights=p[owner], minlength=n_features)
        slope = np.concatenate([(seen - expected - ridge * crf.weights), (pairs - _pairs(forward, backward, start, crf.cross) - ridge * crf.cross).ravel()]) / n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        crf.weights = crf.weights + step[:n_features]
        crf.cross = crf.cross + step[n_features:].reshape(2, 2)
    return crf


def viterbi(score: list[float], cross: list[list[float]]) -> list[int]:
    """The likeliest labels of one sequence; label 0 on ties."""
    best0, best1, back = 0.0, 0.0, []
    for i, s in enumerate(score):
        if i:
            a, b = best0 + cross[0][0], best1 + cross[1][0]
            c, d = best0 + cross[0][1], best1 + cross[1][1]
            back.append((int(b > a), int(d > c)))
            best0, best1 = max(a, b), max(c, d)
        best1 += s
    if not score:
        return []
    label = int(best1 > best0)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]
