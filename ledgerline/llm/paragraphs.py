"""Substring dedup over paragraphs: MinHash banding, exact Jaccard, components.

Paragraphs are lines; near copies of a line meet under bands tuned to miss one
pair in a thousand at Jaccard 0.75, are verified exactly and joined to clusters.
A passage inside longer lines is no near copy of any line, so texts are also cut
where a word's hash is the largest of its neighbourhood: the same words are cut
alike anywhere, and such pieces count as copies when their shingles are equal.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm import shingles
from ledgerline.llm.common import binaries, map_batches, utf8
from ledgerline.llm.near import SENT_IDS, near_components, shared_keys
from ledgerline.session import staged

PERCENT, BANDS, ROWS = 75, 8, 2
# A word is a cut if no word this near has a larger hash: pieces have 13 words on average.
REACH = 6
# Shorter repeated runs are left alone: headings, salutations, licence lines.
MIN_WORDS = 16
# Units: copies of an earlier line, other lines, pieces in copies of an earlier line, other pieces; a word goes by the last of the order below.
GONE, LINE, HIDDEN, PIECE = range(4)
_RANK = {LINE: 0, HIDDEN: 1, PIECE: 1, GONE: 2}


def cuts(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True where a word's hash is above those before and not below those after it, within reach and its text."""
    out = np.ones(len(words), bool)
    for k in range(1, min(REACH, len(words) - 1) + 1):
        same = text[k:] == text[:-k]
        out[k:] &= ~same | (words[k:] > words[:-k])
        out[:-k] &= ~same | (words[:-k] >= words[k:])
    return out


def _units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, group of each word) and (text, first word, words, is a line) of each group: lines, then pieces."""
    words, text = shingles.word_hashes(texts)
    first_of = np.searchsorted(text, np.arange(len(texts) + 1))
    per_line = [[len(x.split()) for x in t.split(b"\n")] for t in texts]
    sizes = np.array([n for x in per_line for n in x], np.int64)
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(sizes)), sizes)
    at = cuts(words, text)
    starts = at | np.concatenate([[True], text[1:] != text[:-1]]) if len(words) else at
    piece = np.cumsum(starts) - 1
    long_lines = np.flatnonzero(sizes >= MIN_WORDS)
    piece_first = np.flatnonzero(starts)
    piece_sizes = np.diff(np.append(piece_first, len(words)))
    firsts = np.concatenate([ends[long_lines] - sizes[long_lines], piece_first])
    counts = np.concatenate([sizes[long_lines], piece_sizes])
    is_line = np.concatenate([np.ones(len(long_lines), bool), np.zeros(len(piece_first), bool)])
    owner = text[firsts] if len(firsts) else firsts
    return words, line, piece, owner, firsts, counts, is_line, firsts - first_of[owner], long_lines


def _distinct(words: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, group) sorted by both, each once; groups of fewer than five words give one of the whole."""
    if not len(words):
        return words, group
    width = shingles.WIDTH
    roll, owner = shingles.rolled(words), group[: max(0, len(words) - width + 1)]
    inside = group[width - 1 :] == owner if len(words) >= width else np.zeros(0, bool)
    roll, owner = roll[inside], owner[inside]
    sizes = np.bincount(group, minlength=n)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        bounds = np.searchsorted(group, short)
        extra = np.concatenate([shingles.whole(words[b : b + sizes[g]]) for g, b in zip(short, bounds)])
        roll, owner = np.concatenate([roll, extra]), np.concatenate([owner, short])
    order = np.lexsort((roll, owner))
    roll, owner = roll[order], owner[order]
    keep = np.ones(len(roll), bool)
    keep[1:] = (roll[1:] != roll[:-1]) | (owner[1:] != owner[:-1])
    return roll[keep], owner[keep]


def _ids(roll: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set hash and number of shingles of every group."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(roll))])
    count = np.diff(bounds)
    return shingles.mix(sums[bounds[1:]] - sums[bounds[:-1]] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64), bounds


def paragraph_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, first word, words, id (hash of the set of shingles), keys (lines only) of every line and piece."""
    band = shingles.Bands(bands, rows)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, line, piece, owner, firsts, counts, is_line, place, long_lines = _units(binaries(batch.column("text")))
        n_lines = int(line.max()) + 1 if len(line) else 0
        lines, line_owner = _distinct(words, line, n_lines)
        line_ids, line_bounds = _ids(lines, line_owner, n_lines)
        pieces, piece_owner = _distinct(words, piece, int((~is_line).sum()))
        piece_ids, _ = _ids(pieces, piece_owner, int((~is_line).sum()))
        keys = [band.keys(lines[line_bounds[g] : line_bounds[g + 1]]) for g in long_lines]
        rows_, docs_ = (batch.column(c).take(pa.array(owner)) for c in ("row", "doc_id"))
        out = [rows_, docs_, pa.array(place), pa.array(counts), pa.array(np.concatenate([line_ids[long_lines], piece_ids])), pa.array([*keys, *[None] * len(piece_ids)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(out, ["row", "doc_id", "first", "words", "id", "keys"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    return map_batches(texts, cut, "row long, doc_id long, first long, words long, id long, keys array<long>")


def repeated_passages(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, first_word, n_words, cluster, first_doc, kept: every run of words that repeats in another document.

    Lines that are near copies and pieces that are copies form clusters; runs of
    overlapping and adjacent ones of at least 16 words are reported, in parts that
    share no word. `first_doc` is the smallest document up to which the part repeats,
    with what it touches, for 16 words; a part is kept only there, so what is first in
    a document is never lost by what stands beside it. A part may be shorter than its
    run. Copies of an earlier line go as a whole, with the pieces in them. `cluster` is
    that of the part's first unit from `first_doc`. Repeats inside one document, blank,
    null and empty texts and rows with a null id give nothing. Other columns are not read.
    """
    usable = docs.where(F.col(id_column).isNotNull())
    units = staged(paragraph_units(usable, id_column, text_column), "units")
    keyed = units.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "id")
    members = shared_keys(keyed)
    ids = members.select("id").distinct()
    texts = usable.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    own = staged(_arrays(units, texts, ids), "arrays")

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(b, np.uint64) for b in batch.column("own").to_pylist()]
        n, bits, narrow = pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.bitmap(s, 16) for s in sets], pa.binary()), pa.array(list(map(shingles.narrow, sets)), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), n, bits, narrow], ["id", "n", "bits", "narrow"])

    sets = staged(map_batches(own, sign, "id long, n long, bits binary, narrow array<long>"), "signatures")
    roots = near_components(members, sets, lambda wanted: own.join(wanted, "id", "left_semi"), percent)

    # The documents of each set, then of each cluster: only what occurs in two of them goes on.
    ends = units.groupBy("id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.when(F.col("keys").isNotNull(), F.col("doc_id"))).alias("line_doc"))
    rooted = ends.join(roots, "id", "left").withColumn("cluster", F.coalesce("root", "id"))
    alone = rooted.where("root IS NULL AND low < high").select("id", "cluster", F.col("low").alias("first_doc"), "line_doc")
    joined = rooted.where("root IS NOT NULL").select("id", "cluster", "low", "high", "line_doc")
    spans = joined.groupBy("cluster").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc"), F.min("line_doc").alias("line_doc")).where("first_doc < last_doc")
    repeated = staged(alone.unionByName(joined.drop("line_doc").join(spans, "cluster").select("id", "cluster", "first_doc", "line_doc")), "repeated")
    found = units.withColumn("line", F.col("keys").isNotNull()).drop("keys").join(repeated, "id")

    # Copies of an earlier line go as a whole, with the pieces in them; a piece's first document is looked for among the others.
    gone = F.col("line") & (F.col("line_doc") < F.col("doc_id"))
    end = F.col("first") + F.col("words")
    order = W.partitionBy("row").orderBy("first")
    before = F.max(F.when(gone, end)).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(F.when(gone, F.col("first"))).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    hidden = F.coalesce(before > F.col("first"), F.lit(False)) | F.coalesce(after < end, F.lit(False))
    kind = F.when(gone, GONE).when(F.col("line"), LINE).when(hidden, HIDDEN).otherwise(PIECE)
    marked = staged(found.select("row", "doc_id", "first", "words", "cluster", "first_doc", kind.cast("int").alias("kind")), "found")
    left = marked.groupBy("cluster").agg(F.min("first_doc").alias("was"), F.min(F.when(F.col("kind").isin(LINE, PIECE), F.col("doc_id"))).alias("low"))
    moved = staged(left.where("low IS NULL OR low > was").select("cluster", "low", F.lit(True).alias("moved")), "moved")
    settled = marked.join(moved, "cluster", "left").withColumn("first_doc", F.when(F.col("moved"), F.col("low")).otherwise(F.col("first_doc")))
    unit = F.struct("first", "words", "kind", "cluster", "first_doc")
    by_row = settled.where("first_doc <= doc_id").groupBy("row", "doc_id").agg(F.collect_list(unit).alias("units")).select("doc_id", "units")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(d, *part) for d, own in zip(batch.column("doc_id").to_pylist(), batch.column("units").to_pylist()) for part in parts(own)]
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "first_word", "n_words", "cluster", "first_doc"])

    out = map_batches(by_row, split, "doc_id long, first_word long, n_words long, cluster long, first_doc long")
    return out.withColumn("kept", F.col("doc_id") == F.col("first_doc"))


def parts(units: list[dict]) -> list[tuple[int, int, int, int]]:
    """(first word, words, cluster, first document) of the parts of one text's runs of at least MIN_WORDS words.

    A word goes by the copied line it is in, else by its piece, else by its line.
    """
    who = np.full(max(u["first"] + u["words"] for u in units), -1)
    for i in sorted(range(len(units)), key=lambda i: _RANK[units[i]["kind"]]):
        who[units[i]["first"] : units[i]["first"] + units[i]["words"]] = i
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    sizes = np.diff(np.append(starts, len(who)))
    used = who[starts] >= 0
    at, size, own = starts[used].tolist(), sizes[used].tolist(), [units[i] for i in who[starts][used]]
    level = _levels([u["first_doc"] for u in own], at, size)
    out: list[list[int]] = []
    for i, (f, u) in enumerate(zip(level, own)):
        if f is None:
            continue
        if out and out[-1][3] == f and out[-1][0] + out[-1][1] == at[i]:
            out[-1][1] += size[i]
            if out[-1][2] is None and u["first_doc"] == f:
                out[-1][2] = u["cluster"]
        else:
            out.append([at[i], size[i], u["cluster"] if u["first_doc"] == f else None, f])
    # A part always has a unit of its own level, unless others cut it off: then its first unit names it.
    names = {a: u["cluster"] for a, u in zip(at, own)}
    return [(a, n, names[a] if c is None else c, f) for a, n, c, f in out]


def _levels(docs: list[int], at: list[int], size: list[int]) -> list[int | None]:
    """Of each segment the smallest document up to which the words around it repeat for MIN_WORDS words; None if there is none.

    Segments are added by their first document and hang together with those they touch.
    """
    n = len(docs)
    parent, total, active, level = list(range(n)), list(size), [False] * n, [None] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def touch(i: int) -> bool:
        """Segment i and the next one are both there, without words between them."""
        return 0 <= i < n - 1 and active[i] and active[i + 1] and at[i] + size[i] == at[i + 1]

    for f, same in groupby(sorted(range(n), key=docs.__getitem__), key=docs.__getitem__):
        same = list(same)
        for i in same:
            active[i] = True
            for j in (i - 1, i):
                if touch(j) and (a := find(j)) != (b := find(j + 1)):
                    parent[b] = a
                    total[a] += total[b]
        for i in same:
            if total[find(i)] < MIN_WORDS:
                continue
            level[i] = f
            j = i - 1
            while touch(j) and level[j] is None:
                level[j], j = f, j - 1
            j = i
            while touch(j) and level[j + 1] is None:
                level[j + 1], j = f, j + 1
    return level


def _arrays(units: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own) of the wanted lines, from one document each."""
    places = units.where("keys IS NOT NULL").select("id", "doc_id", "first", "words").join(ids, "id", "left_semi")
    one = places.groupBy("id").agg(F.min(F.struct("doc_id", "first", "words")).alias("p"))
    # A few lines a row: lines that thousands of documents share do not pile up in one of them.
    by_doc = one.select(F.col("p.doc_id").alias("doc_id"), F.struct("id", "p.first", "p.words").alias("line"), F.pmod("id", F.lit(8)).alias("part"))
    wanted = staged(by_doc.groupBy("doc_id", "part").agg(F.collect_list("line").alias("lines")).drop("part"), "wanted")
    few = wanted.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] <= SENT_IDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "doc_id")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids_, own = [], []
        for t, lines in zip(binaries(batch.column("text")), batch.column("lines").to_pylist()):
            words, _ = shingles.word_hashes([t])
            for x in lines:
                part = words[x["first"] : x["first"] + x["words"]]
                s = shingles.grouped_sets(part, np.zeros(len(part), np.int64), 1)[0]
                if len(s) and shingles.set_id(s) == x["id"]:
                    ids_.append(x["id"]), own.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(own, pa.binary())], ["id", "own"])

    return map_batches(found, cut, "id long, own binary").dropDuplicates(["id"])
