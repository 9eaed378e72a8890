"""A Python worker holds little memory between tasks."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from ledgerline.llm import common, shingles


def _anon_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def _task(held: list):
    """Uses 120 MB in blocks below one that stays, as the results of a task do."""

    def run(batches):
        for batch in batches:
            blocks = [b"x" * 60_000 for _ in range(2_000)]
            held.append(b"x" * 60_000)
            del blocks
            yield batch

    return run


def test_freed_memory_goes_back_at_the_end_of_a_task():
    batch, held = pa.RecordBatch.from_pydict({"a": [1]}), []
    common.give_back()
    before = _anon_mb()
    assert len(list(_task(held)(iter([batch])))) == 1
    assert _anon_mb() - before > 60  # what idle workers held
    assert len(list(common.tidy(_task(held))(iter([batch])))) == 1
    assert _anon_mb() - before < 30


def test_mapped_batches_are_tidied(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "tidy", lambda run: seen.append(run) or run)
    out = common.map_batches(spark.range(3), lambda b: b, "id long")
    assert out.count() == 3 and len(seen) == 1


def test_segments_are_small_and_change_no_hash(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"%d" % w for w in rng.integers(0, 5_000, n)) for n in (3, 90_000, 400_000, 1)] + [b"y" * 700_000 + b" z"]
    small = shingles.word_hashes(texts)
    assert sum(t.nbytes for t in shingles._powers(2 * shingles._SEGMENT)) <= 8 << 20
    monkeypatch.setattr(shingles, "_SEGMENT", 1 << 20)
    for a, b in zip(small, shingles.word_hashes(texts)):
        assert np.array_equal(a, b)
