"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least three periods.
Short periods are found by direct scans at their lag. For the others there is a
scale for every range of periods: grams a little longer than the longest period
of the range are hashed, and the minima of windows of neighbouring grams are
kept. Inside a run the windows at i and i + q are equal, so their minima lie q
apart; and as a gram is no shorter than the period, equal grams of a run stand
whole periods apart only. So each run shows two neighbouring equal minimizers at
the distance q, which seed an exact extension to both sides. Words are compared
by numbers that stand for whole words, so what is returned is exact; a run
could only be missed where 64-bit hashes of different grams collide.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import binaries, map_batches, utf8
from ledgerline.llm.shingles import mix

# Fewest words and periods of a run; periods up to DIRECT are scanned lag by lag.
LEAST, PERIODS, DIRECT = 24, 3, 8
# The grams of a scale exceed its shortest period by at most this factor.
STEP = 1.25
_BASE = 0x9E3779B97F4A7C15


class _Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def seeded(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, for the documents that are made periodic; None for the others.

    h is the crc32 of the decimal id. If h is divisible by ten, words from a = g % n on
    (g = h // 10) repeat with period 1 + (n - a) // (3 + g % 8). Null ids are left alone.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period.

    `words` are the numbers of several texts one after the other, longest text first,
    each followed by a number that occurs nowhere else; `lengths` count that number in.
    """
    ends = np.cumsum(lengths)
    found = [_direct(words, q, least, periods) for q in range(1, min(DIRECT, len(words) - 1) + 1)]
    longest = int(lengths[0]) - 1 if len(lengths) else 0
    hashes = mix(words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    power, inverse, sums = _sums(hashes)
    low = DIRECT + 1
    while periods * low <= longest:
        gram = max(low, int(STEP * low))
        # Texts that can hold three of the shortest period come first.
        many = int(np.searchsorted(-lengths, -(periods * low + 1), side="right"))
        n = int(ends[many - 1])
        window = max(1, min(low, (periods - 1) * low - gram + 1))
        found.append(_seeded(words[:n], (sums[gram : n + 1] - sums[: n - gram + 1]) * inverse[: n - gram + 1], low, gram, window, least, periods))
        low = gram + 1
    start, end, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers, their inverses and the running sums from which the hash of any gram follows."""

    def table(base: int) -> np.ndarray:
        out = np.full(len(hashes) + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    power, inverse = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return power, inverse, sums


def _direct(words: np.ndarray, q: int, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one period, by comparing all words with those q further on."""
    same = np.zeros(len(words) - q + 2, np.int8)
    same[1:-1] = words[q:] == words[:-q]
    step = np.diff(same)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
    keep = last - first >= max(least, periods * q)
    first, last = first[keep], last[keep]
    whole = np.array([_smallest(words, int(s), q) for s in first], bool)
    first, last = first[whole], last[whole]
    return first, last, np.full(len(first), q)


def _smallest(words: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the stretch from `start` on with period q."""
    rest, factor = q, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            p = q // factor
            if (words[start : start + q - p] == words[start + p : start + q]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _seeded(words, grams, low: int, high: int, window: int, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the periods `low` to `high`, from pairs of equal minimizers."""
    grams = mix(grams)
    at = _minimizers(grams, window)
    value = grams[at]
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    gap = at[1:] - at[:-1]
    pair = np.flatnonzero((value[1:] == value[:-1]) & (gap >= low) & (gap <= high))
    seeds = sorted(zip(gap[pair].tolist(), at[pair].tolist()))
    out, reach = [], (0, -1)
    for q, place in seeds:
        if reach[0] == q and place + q < reach[1]:
            continue  # inside the stretch found last
        last = place + q + _same_ahead(words, place, q)
        first = place - _same_behind(words, place, q)
        reach = (q, last)
        if last - first >= max(least, periods * q) and _smallest(words, first, q):
            out.append((first, last, q))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some window of so many neighbours."""
    n = len(grams) - window + 1
    if n < 1:
        return np.arange(len(grams))
    least, width = grams, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:n], least[window - width : window - width + n])
    # A place is kept if the largest of the minima of the windows over it is its own hash.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least[:n], np.zeros(window - 1, np.uint64)])
    most, width = padded, 1
    while 2 * width <= window:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    if width < window:
        most = np.maximum(most[: len(grams)], most[window - width : window - width + len(grams)])
    return np.flatnonzero(most[: len(grams)] == grams)


def _same_ahead(words: np.ndarray, place: int, q: int) -> int:
    """How many words from `place` on equal those q further on."""
    done, step = 0, 64
    while True:
        a, b = words[place + done : place + done + step], words[place + q + done : place + q + done + step]
        differs = np.flatnonzero(a[: len(b)] != b)
        if len(differs):
            return done + int(differs[0])
        if len(b) < step:
            return done + len(b)
        done, step = done + step, 2 * step


def _same_behind(words: np.ndarray, place: int, q: int) -> int:
    """The same for the words before `place`."""
    done, step = 0, 64
    while True:
        end = place - done
        begin = max(0, end - step)
        differs = np.flatnonzero(words[begin:end] != words[begin + q : end + q])
        if len(differs):
            return done + end - begin - 1 - int(differs[-1])
        if not begin:
            return place
        done, step = done + step, 2 * step


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed binary, run_starts array<long>, run_lengths array<long>, run_periods array<long>"


def collapse_runs(docs: DataFrame, seed: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs and collapsed text of every row of `docs`.

    run_starts, run_lengths and run_periods list all runs by start, then period;
    start, length, period and exponent_milli are those of the run with the
    greatest length / period (ties: smallest start, then period), null without
    runs; collapsed is the text as bytes, each word that some run holds after its
    first period left out. `seed` makes a tenth of the documents periodic first
    (see `seeded`). Null, empty and blank texts have no words and no runs. A null
    id is kept and its text never made periodic; repeated rows are documents of
    their own; other columns are not read. Texts are taken whole.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = _Numbers()
        ids, split, own = batch.column("doc_id").to_pylist(), [], []
        for doc_id, text in zip(ids, binaries(batch.column("text"))):
            words = text.split()  # at 0x20 and 0x09-0x0D only
            number = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            place = seeded(len(words), doc_id) if seed else None
            if place is not None:
                words, number = [words[i] for i in place.tolist()], number[place]
            split.append(words), own.append(number)
        order = sorted(range(len(own)), key=lambda i: -len(own[i]))
        lengths = np.array([len(own[i]) + 1 for i in order])
        # Numbers from len(numbers) on stand between texts, each once.
        joined = np.concatenate([x for k, i in enumerate(order) for x in (own[i], [len(numbers) + k])])
        start, end, period = find_runs(joined, lengths)
        offset = np.cumsum(lengths) - lengths
        bounds = np.searchsorted(start, np.concatenate([offset, [len(joined)]]))
        rows: list = [None] * len(own)
        for k, i in enumerate(order):
            a, b = bounds[k], bounds[k + 1]
            rows[i] = (ids[i], *_described(split[i], start[a:b] - offset[k], end[a:b] - offset[k], period[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return map_batches(texts, search, SCHEMA)


_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.binary())]
    + [(c, _LONGS) for c in ("run_starts", "run_lengths", "run_periods")]
)


def _described(words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple:
    runs = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
    best: tuple = (None, None, None, None)
    if runs:
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (*top, 1000 * top[1] // top[2])
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, end, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
    collapsed = b" ".join(words)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    shas = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    return (len(runs), *best, *shas, collapsed, *([r[k] for r in runs] for k in range(3)))


def run_report(docs: DataFrame) -> DataFrame:
    """The digest of `collapse_runs` over documents of which a tenth are made periodic."""
    return collapse_runs(docs, seed=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
