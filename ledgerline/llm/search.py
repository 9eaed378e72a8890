"""Exact BM25 top-k: inverted index per shard, block-max WAND, exact merge.

The words of all texts are counted once for what scores need of the whole
corpus: documents, words, documents a query word is in. Shards of a bounded
number of documents then hold an inverted index of the query words, with the
largest score of each word in each block of documents. A query has a cursor a
word. Cursors are kept by the block they stand at; the first at which the words'
largest scores add up to the k-th best so far is the pivot. Cursors behind it
jump there, and the block is scored only if the largest scores its words have in
it reach that score as well. The shards' best are merged by the same order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm.common import binaries, map_batches, utf8
from ledgerline.session import staged

TOP, K1, B = 10, 1.2, 0.75
SHARD_DOCS, BLOCK_DOCS = 20_000, 64
# Queries are a stated, small set; they are sent to every task in blocks of so many.
QUERY_BLOCK = 1_000
# Scores are ordered after rounding to this many decimals, so equal texts tie.
DECIMALS = 6


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # A-Z only, at 0x20 and 0x09-0x0D only


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the `top` best rows for each query, of those that hold one of its words.

    Score, rounded, descending, then the smaller id; null ids last. Words are
    lower-cased A-Z runs between white space; a query's words count once. Null and
    empty texts are documents without words; queries without words, or whose words
    no document has, give no rows. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    asked = [(r[0], sorted(set(_words(bytes(r[1]))))) for r in queries.select(F.col(query_id).cast("long"), utf8(F.col(query_text))).collect()]
    blocks = [asked[i : i + QUERY_BLOCK] for i in range(0, len(asked), QUERY_BLOCK)] or [[]]
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    found = [_search_block(spark, texts, block, top) for block in blocks]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(spark, texts: DataFrame, asked: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    terms = {w: i for i, w in enumerate(sorted({w for _, ws in asked for w in ws}))}
    sent = spark.sparkContext.broadcast((terms, [(q, [terms[w] for w in ws]) for q, ws in asked]))

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value[0]
        length, term, count = [], [], []
        for t in binaries(batch.column("text")):
            words = _words(t)
            own = Counter(filter(None.__ne__, map(known.get, words)))
            length.append(len(words)), term.append(list(own)), count.append(list(own.values()))
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length, pa.int64()), pa.array(term, ints), pa.array(count, ints)], ["doc_id", "length", "terms", "counts"])

    postings = staged(map_batches(texts, post, "doc_id long, length long, terms array<int>, counts array<int>"), "postings")
    whole = postings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    n, mean = whole["n"], max(whole["words"] / max(1, whole["n"]), 1e-9)
    # One row a query word.
    held = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = np.array([np.log(1 + (n - held.get(i, 0) + 0.5) / (held.get(i, 0) + 0.5)) for i in range(len(terms))])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, rows = [], 0
        for batch in batches:
            held_back.append(batch)
            rows += batch.num_rows
            if rows >= SHARD_DOCS:
                yield _best(pa.Table.from_batches(held_back), sent.value[1], weight, mean, top)
                held_back, rows = [], 0
        if rows:
            yield _best(pa.Table.from_batches(held_back), sent.value[1], weight, mean, top)

    found = postings.where(F.size("terms") > 0).mapInArrow(shard, "query_id long, doc_id long, score double")
    # Each task keeps its best of a query before rows meet.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


class _Index:
    """Postings of one shard by word, with the largest score of every word in every block of documents.

    An entry is what one word has in one block: its block, its largest score and
    its postings. Entries of a word stand in document order.
    """

    def __init__(self, table: pa.Table, weight: np.ndarray, mean: float) -> None:
        self.ids = np.array([np.iinfo(np.int64).max if d is None else d for d in table.column("doc_id").to_pylist()])
        terms = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(self.ids)), pc.list_value_length(terms).to_numpy())
        term, count = terms.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(float)
        length = table.column("length").to_numpy()[doc]
        score = weight[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        order = np.lexsort((doc, term))
        term, self.doc, self.score = term[order], doc[order], score[order]
        block = self.doc // BLOCK_DOCS
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, int)
        self.start = np.append(starts, len(term))
        self.block = block[starts]
        self.peak = np.maximum.reduceat(self.score, starts) if len(term) else np.zeros(0)
        self.first = np.searchsorted(term[starts], np.arange(len(weight) + 1))
        self.scored = 0

    def best(self, own: list[int], top: int) -> list[tuple[float, int, int]]:
        """The best documents for the words: (-score, id, place), ascending."""
        own = [t for t in own if self.first[t] < self.first[t + 1]]
        if not own:
            return []
        low, high = self.first[own], self.first[np.array(own) + 1]
        whole = np.array([self.peak[i:j].max() for i, j in zip(low, high)])
        blocks = [self.block[i:j] for i, j in zip(low, high)]
        at, over = low.copy(), np.iinfo(np.int64).max
        stands = self.block[at]
        best: list[tuple[float, int, int]] = []
        while True:
            # What cannot reach the k-th best, rounding included, is passed by.
            bar = -best[-1][0] - 2 * 10.0**-DECIMALS if len(best) == top else 0.0
            order = np.argsort(stands, kind="stable")
            reach = np.cumsum(whole[order]) >= bar
            pivot = int(np.argmax(reach))
            if not reach[pivot] or stands[order[pivot]] == over:
                return best
            b = stands[order[pivot]]
            behind = np.flatnonzero(stands < b)
            for i in behind:
                at[i] = low[i] + np.searchsorted(blocks[i], b)
                stands[i] = self.block[at[i]] if at[i] < high[i] else over
            here = np.flatnonzero(stands == b)
            if self.peak[at[here]].sum() >= bar:
                best = self._score(int(b), at[here], best, top)
            at[here] += 1
            for i in here:
                stands[i] = self.block[at[i]] if at[i] < high[i] else over

    def _score(self, b: int, entries: np.ndarray, best: list, top: int) -> list[tuple[float, int, int]]:
        """`best` with the documents of one block."""
        self.scored += 1
        sums = np.zeros(BLOCK_DOCS)
        for e in entries:
            held = slice(self.start[e], self.start[e + 1])
            sums[self.doc[held] - b * BLOCK_DOCS] += self.score[held]
        sums = np.round(sums, DECIMALS)
        found = [(-sums[k], int(self.ids[b * BLOCK_DOCS + k]), int(b * BLOCK_DOCS + k)) for k in np.flatnonzero(sums > 0)]
        return sorted(best + found)[:top]


def _best(table: pa.Table, asked, weight: np.ndarray, mean: float, top: int) -> pa.RecordBatch:
    """The best documents of one shard for each query."""
    index = _Index(table, weight, mean)
    out = [(query, None if i == np.iinfo(np.int64).max else i, -s) for query, own in asked for s, i, _ in index.best(own, top)]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    columns = list(zip(*out)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "doc_id", "score"])
