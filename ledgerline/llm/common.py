"""Pieces the operators share: columns, batches and the session settings they need."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.session import configure

# A word is a run of anything but these separators.
WORD = r"[^\x20\x09-\x0D]+"
# Rows and bytes of one Arrow batch: some long texts must fit beside the arrays made from them.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def utf8(text: Column) -> Column:
    """The text as bytes, empty for null: Python workers then split and hash without decoding."""
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b"").cast("binary"))


def binaries(column: pa.Array) -> list[bytes]:
    return column.to_pylist()


# Large tables that a worker process keeps from task to task, by the operator they belong to: how to let go of them.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, release: Callable[[], None]) -> None:
    _kept[owner] = release


def make_room(owner: str | None = None) -> None:
    """Let go of what other operators keep: a worker serves one after the other, and its memory would add up."""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system; else the C library and Arrow hold it for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """The same function of an iterator of batches; at the end of a task it gives freed memory back.

    A worker idles for a minute beside the executor's JVM, while that runs steps without Python.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def map_batches(df: DataFrame, function, schema: str, owner: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch that gives one batch (or None); what operators but `owner` keep is released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)
