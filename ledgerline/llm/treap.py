"""Ranked search on K2-treaps: compressed quadtrees over the grid of terms and documents.

Documents are indexed in shards. The grid of a shard has a row per term, the most
frequent first, a column per document by ascending id, and the impact of the term
on the document where it occurs. A treap halves rows and columns again and again
and keeps only cells that are not empty, each with the marks of its four children
and the largest impact inside. A query item follows the paths of its terms' rows
together: a range of documents is bounded by the weighted maxima of the cells its
rows pass through there, and ranges are split by descending bound until no range
left can hold one of the best documents. Then the shards' best are merged.

Impacts hold the corpus-wide counts of documents and terms; the weight of a term
is a factor of its row and joins at query time. All scores are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm.common import binaries, give_back, make_room, map_batches, tidy, utf8
from ledgerline.session import staged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
# A shard ends with the batch in which its documents hold so many terms, repeats counted, or there are so many documents.
SHARD_TERMS, SHARD_DOCS = 1_000_000, 32_768
# Items searched in one pass over the index; their terms and weights are sent to all tasks.
ITEM_BLOCK = 2_000
# Ranges split in one step, the best ones first.
BEAM = 128

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
# Of four marks: how many there are, and how many come before each.
_MARKS = np.array([m.bit_count() for m in range(16)], np.uint8)
_BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int64)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text: letters A-Z lower-cased, anything else of ASCII but digits and letters parts them."""
    return text.translate(_KEEP).split()


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, before the weight of the term."""
    m = 50 + 50 * n * documents // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _packed(values: np.ndarray) -> bytes:
    """The length and the compressed bytes: most drops are 0, as each cell has a quarter with its own peak."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(written: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(written)[8:], int.from_bytes(written[:8], "little"), codec="zstd"), kind)


@dataclass
class Treap:
    """Cells level by level; the children of a cell follow each other in the next level."""

    levels: int
    marks: np.ndarray  # of all cells: which quarters have cells; bit 2 * (lower rows) + (later documents)
    peaks: np.ndarray  # largest impact inside
    first: np.ndarray  # of all cells: the number of the first child

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From distinct (row, column) points. Cell 0 stands for an empty one, cell 1 is the whole grid."""
        levels = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.uint64)
        for b in range(levels):
            code |= ((rows >> b & 1) << (2 * b + 1) | (columns >> b & 1) << (2 * b)).astype(np.uint64)
        order = np.argsort(code, kind="stable")
        code, peak = code[order], values[order].astype(np.uint32)
        del order
        marks, peaks = [np.zeros(len(code), np.uint8)], [peak]
        for _ in range(levels):
            above = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(code) else np.zeros(0, np.int64)
            quarter = np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)
            marks.append(np.bitwise_or.reduceat(quarter, starts) if len(starts) else quarter)
            peak = np.maximum.reduceat(peak, starts) if len(starts) else peak
            peaks.append(peak)
            code = above[starts]
        empty = np.zeros(1, np.uint8), np.zeros(1, np.uint32)
        return cls._linked(levels, np.concatenate([empty[0], *marks[::-1]]), np.concatenate([empty[1], *peaks[::-1]]))

    @classmethod
    def _linked(cls, levels: int, marks: np.ndarray, peaks: np.ndarray) -> Treap:
        many = _MARKS[marks]
        first = np.cumsum(many, dtype=np.int32 if len(marks) < 2**30 else np.int64)
        first -= many
        first += 2
        return cls(levels, marks, peaks, first)

    def written(self) -> tuple[bytes, bytes]:
        """Marks of all cells but the last level's, and how far each peak lies below that of the cell around it, compressed."""
        points = len(self.marks) - int(np.searchsorted(self.first, len(self.marks)))
        inner = self.marks[: len(self.marks) - points]
        around = np.repeat(self.peaks[1 : len(inner)], _MARKS[inner[1:]])
        np.subtract(around, self.peaks[2:], out=around)
        return _packed(inner[1:]), _packed(np.concatenate([self.peaks[1:2], around]))

    @classmethod
    def read(cls, levels: int, marks: bytes, drops: bytes) -> Treap:
        inner, drop = _unpacked(marks, np.uint8), _unpacked(drops, np.uint32)
        peaks = np.zeros(len(drop) + 1, np.uint32)
        peaks[1:2] = drop[:1]
        begin, end = 0, min(1, len(inner))  # the cells of one level
        while begin < end:
            around = np.repeat(peaks[1 + begin : 1 + end], _MARKS[inner[begin:end]])
            peaks[1 + end : 1 + end + len(around)] = around - drop[end : end + len(around)]
            begin, end = end, min(end + len(around), len(inner))
        return cls._linked(levels, np.concatenate([np.zeros(1, np.uint8), inner, np.zeros(len(drop) - len(inner), np.uint8)]), peaks)

    def best(self, rows: np.ndarray, weights: np.ndarray, top: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(column, score): the `top` columns of largest weighted sum over the rows, above 0, ties to the smaller column."""
        bits = (rows[None, :] >> np.arange(self.levels - 1, -1, -1)[:, None] & 1) * 2
        cells = np.ones((1, len(rows)), np.int64) * (len(self.marks) > 1)
        bound, low, level = np.array([int((self.peaks[cells[0]] * weights).sum())]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            bar = scores[-1] if len(scores) == top else 1
            # A range that only reaches the last score counts if it lies before that column.
            may = (bound > bar) | (bound == bar) & (low < columns[-1] if len(scores) == top else True)
            if not may.all():
                bound, low, level, cells = bound[may], low[may], level[may], cells[may]
                if not len(bound):
                    break
            if len(bound) > beam:
                pick = np.argpartition(-bound, beam - 1)[:beam]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
                now = bound[pick], low[pick], level[pick], cells[pick]
                bound, low, level, cells = bound[rest], low[rest], level[rest], cells[rest]
            else:
                now = bound, low, level, cells
                bound, low, level, cells = bound[:0], low[:0], level[:0], cells[:0]
            mark, first = self.marks[now[3]], self.first[now[3]]
            width = np.int64(1) << (self.levels - 1 - now[2])
            for half in (0, 1):
                quarter = bits[now[2]] + half
                child = np.where(mark >> quarter & 1, first + _BEFORE[mark, quarter], 0)
                reach = (self.peaks[child] * weights).sum(axis=1)
                ok = reach >= bar
                child, reach, place, deep = child[ok], reach[ok], now[1][ok] + half * width[ok], now[2][ok] + 1
                done = deep == self.levels
                if done.any():
                    columns, scores = np.concatenate([columns, place[done]]), np.concatenate([scores, reach[done]])
                    order = np.lexsort((columns, -scores))[:top]
                    columns, scores = columns[order], scores[order]
                if not done.all():
                    more = ~done
                    bound, low = np.concatenate([bound, reach[more]]), np.concatenate([low, place[more]])
                    level, cells = np.concatenate([level, deep[more]]), np.concatenate([cells, child[more]])
        return columns, scores


_SHARD = "doc_ids array<long>, terms array<binary>, held array<long>, levels int, marks binary, drops binary"


def index(docs: DataFrame, documents: int, total: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a shard: its documents' ids by column, its terms by row with the documents that hold each, and its treap."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text"))):
                shard.add(doc_id, text)
            if shard.size >= SHARD_TERMS or len(shard.ids) >= SHARD_DOCS:
                yield shard.row(documents, total)
                shard = _Shard()
                give_back()
        if shard.ids:
            yield shard.row(documents, total)

    return texts.mapInArrow(tidy(build), _SHARD)


class _Numbers(dict):
    def __missing__(self, term):
        number = self[term] = len(self)
        return number


class _Shard:
    """Term counts of some documents, until they are laid out as a treap."""

    def __init__(self):
        self.numbers, self.ids, self.lengths, self.tokens, self.size = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            self.tokens.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
            self.ids.append(doc_id), self.lengths.append(len(terms))
            self.size += len(terms)

    def row(self, documents: int, total: int) -> pa.RecordBatch:
        """The shard as one row; its counts are let go of on the way."""
        # Documents without a term are in no shard: no item finds them.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        length = np.array(self.lengths, np.int64)
        width = max(1, len(self.ids))
        terms, held = pa.array(list(self.numbers), pa.binary()), len(self.numbers)
        self.numbers = _Numbers()
        points = np.concatenate(self.tokens).astype(np.int64)
        self.tokens = []
        points *= width
        points += np.repeat(column, length)
        points.sort()
        starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
        tf = np.diff(starts, append=len(points))
        points = points[starts]
        number, place = points // width, points % width
        del points, starts
        held = np.bincount(number, minlength=held)
        rank = np.argsort(-held, kind="stable")
        row = np.empty(len(rank), np.int64)
        row[rank] = np.arange(len(rank))
        treap = Treap.of(row[number], place, impacts(tf, length[order][place], documents, total))
        del number, place, tf, row
        marks, drops = treap.written()
        lists = [pa.array([self.ids[i] for i in order], pa.int64()), terms.take(pa.array(rank)), pa.array(held[rank], pa.int64())]
        values = [*(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists), pa.array([treap.levels], pa.int32()), pa.array([marks], pa.binary()), pa.array([drops], pa.binary())]
        return pa.RecordBatch.from_arrays(values, ["doc_ids", "terms", "held", "levels", "marks", "drops"])


def counts(docs: DataFrame, text_column: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, repeats counted."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [len(terms_of(t)) for t in binaries(batch.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array([sum(map(bool, own))], pa.int64()), pa.array([sum(own)], pa.int64())], ["docs", "terms"])

    both = map_batches(docs.select(utf8(F.col(text_column)).alias("text")), count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return both[0] or 0, both[1] or 0


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents with a score above 0 for each item.

    Largest score first, ties to the smaller id, null ids last. Null, empty and term-less texts
    have no terms: such documents are not counted and never found, such items find nothing. A
    document that repeats an id is a document of its own; rows that repeat an item id (a null one,
    too) are one item with the terms of all, each counted once. Whole texts are read; other
    columns are not. The index is built once and read once per ITEM_BLOCK items.
    """
    spark = docs.sparkSession
    documents, total = counts(docs, text_column)
    # A row group a shard: writers and readers hold one at a time, however many a file has.
    shards = staged(index(docs, documents, total, id_column, text_column), "treaps", **{"parquet.block.row.count.limit": "1"})

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [sorted(set(terms_of(t))) for t in binaries(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    asked = map_batches(items.select(F.col(item_id).cast("long").alias("item_id"), utf8(F.col(item_text)).alias("text")), split, "item_id long, terms array<binary>")
    asked = asked.select("item_id", F.explode("terms").alias("term")).distinct()
    # The documents that hold a term, over all shards; each shard has counted its own.
    wanted = asked.select("term").distinct()
    held = shards.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    df = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    blocks = max(1, math.ceil(asked.agg(F.count_distinct(F.coalesce("item_id", F.lit(-1)))).first()[0] / ITEM_BLOCK))
    weighed = staged(weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "weighed")

    found = [_search(spark, shards, weighed.where(F.col("block") == b), top) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def _search(spark, shards: DataFrame, weighed: DataFrame, top: int) -> DataFrame:
    """The best of every shard for the items of one block."""
    own = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()
    wanted = {t: k for k, t in enumerate(sorted({bytes(t["term"]) for r in own for t in r["terms"]}))}
    asked = [(r["item_id"], np.array([wanted[bytes(t["term"])] for t in r["terms"]], np.int64), np.array([t["weight"] for t in r["terms"]], np.int64)) for r in own]
    sent = spark.sparkContext.broadcast((list(wanted), asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        known = pa.array(sent.value[0], pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms = (batch.column(c)[i].values for c in ("doc_ids", "terms"))
                treap = Treap.read(*(batch.column(c)[i].as_py() for c in ("levels", "marks", "drops")))
                # The row of each wanted term, -1 where the shard has none.
                number = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                at, row = np.flatnonzero(number >= 0), np.full(len(known), -1, np.int64)
                row[number[at]] = at
                out: list[tuple] = []
                for item, own_terms, weights in sent.value[1]:
                    rows = row[own_terms]
                    some = rows >= 0
                    if some.any():
                        columns, scores = treap.best(rows[some], weights[some], top)
                        out.append((pa.array([item] * len(columns), pa.int64()), ids.take(pa.array(columns)), pa.array(scores, pa.int64())))
                columns = [pa.concat_arrays(c) for c in zip(*out)] or [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return shards.select("doc_ids", "terms", "levels", "marks", "drops").mapInArrow(tidy(search), "item_id long, doc_id long, score long")
