"""Packing token sequences by the sum-of-squares rule.

Documents become ids; what is longer than a sequence is cut. Pieces are dealt
evenly to shards that do not grow with the data; in a shard the open bins are
counted per residual gap, and each piece, longest first, goes where the sum of
the squared counts becomes smallest (of equal ones, into the smallest gap).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import binaries, keep, map_batches, tidy, utf8
from ledgerline.session import staged

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
# Pieces a shard packs: enough to leave few bins open, a few megabytes in a task.
SHARD_PIECES = 60_000
# Words whose ids a worker keeps.
KEPT_WORDS = 600_000
# Line by line: letters without marks and a run of plain signs, which are one or two tokens of the word splitter,
# whatever follows; two empty groups for any other line.
_PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=?@\[-`{-~]*)$|.+$)", re.MULTILINE)


class WordEncoder:
    """Ids of texts with each distinct white-space-free string encoded once.

    The vocabulary drops white space and no token crosses it, so ids of a text
    are those of its parts. Plain parts are encoded many at a time and told apart
    by their end-of-word ids; all others one by one.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if os.sep not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.parts: dict[str, list[int]] = {"": []}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self._clear()
        parts = [t.split() for t in texts]
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            words = [flat[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(words)))
            at[missing] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.size[at] if len(at) else at
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.first[at] - ends[:-1], sizes) + np.arange(ends[-1])] if len(at) else self.ids[:0]
        bounds = ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _learn(self, new: list[bytes]):
        """Ids of new strings; plain ones from those of their lower-cased letters and their signs, which many share."""
        lines = b"\n".join(new).decode("utf-8", "replace")
        plain = [(letters.lower(), signs) for letters, signs in _PLAIN.findall(lines)]
        parts = self.parts
        self._learn_parts([part for part in dict.fromkeys(chain.from_iterable(plain)) if part not in parts])
        found = [parts[letters] + parts[signs] for letters, signs in plain]
        for i in [i for i, own in enumerate(found) if not own]:
            found[i] = self.tokenizer.encode(new[i].decode("utf-8", "replace"), add_special_tokens=False).ids
        sizes = np.array(list(map(len, found)), np.int64)
        base, start = len(self.known), len(self.ids)
        self.known.update(zip(new, range(base, base + len(new))))
        self.size = np.concatenate([self.size, sizes])
        self.first = np.concatenate([self.first, start + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def _learn_parts(self, new: list[str]):
        """Runs of letters or of signs: each is one word to the splitter, so one end-of-word id ends it."""
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, encoded):
            ids = e.ids
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(g) and stops[-1] == len(ids):
                self.parts.update(zip(g, (ids[a:b] for a, b in zip([0, *stops], stops))))
            else:
                self.parts.update((w, self.tokenizer.encode(w, add_special_tokens=False).ids) for w in g)


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> WordEncoder:
    keep("packing", encoder.cache_clear)
    return WordEncoder(vocabulary)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with the end id, cut at the capacity."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, piece, start, length, crc = [], [], [], [], []
        for doc, own in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode(binaries(batch.column("text")))):
            own = np.append(own, np.uint32(END_ID)).astype("<u4")
            for k, s in enumerate(range(0, len(own), capacity)):
                part = own[s : s + capacity]
                ids.append(doc), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, piece, start, length, crc), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    return map_batches(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long", "packing")


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given; no length above the capacity.

    open_[g] counts the open bins with gap g. Moving a piece of s from gap g to
    g - s changes the sum of squares by 2 (open_[g - s] - open_[g]) + 2, or by
    1 - 2 open_[g] if the bin is then full; a new bin by 2 open_[capacity - s] + 1.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            out[i], offset[i], made = made, 0, made + 1
            continue
        gaps = open_[s : capacity + 1]
        change = 2 * (open_[: capacity + 1 - s] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * open_[capacity - s] + 1  # gap of a whole sequence: a new bin
        gap = int(np.argmin(change)) + s
        if gap == capacity:
            b, made = made, made + 1
        else:
            open_[gap] -= 1
            b = bins[gap].pop()
        out[i], offset[i] = b, capacity - gap
        if gap > s:
            open_[gap - s] += 1
            bins[gap - s].append(b)
    return out, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_pieces: int = SHARD_PIECES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are one piece of the end id alone. Repeated rows and
    null ids are packed like others. An empty table gives no rows. Other columns
    are not read. Pieces are dealt round robin, so no id is too frequent.
    """
    pieces = staged(token_pieces(docs, capacity, vocabulary, id_column, text_column), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), schema)
        if not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bin_, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        shard = TaskContext.get().partitionId()
        table = table.append_column("sequence_id", pa.array(bin_ + (shard << 32))).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=50_000)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return pieces.repartition(shards).mapInArrow(tidy(packed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
