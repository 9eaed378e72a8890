"""Near-duplicate embeddings by a random-projection tree forest with spill.

Every tree halves the vectors again and again at the median of a random
direction; vectors near a cut go to both sides. Vectors in one leaf are compared
in double precision. A pair is counted in the first leaf the two share only, so
degrees add up without a table of pairs, and each leaf hands on one link a vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import map_batches
from ledgerline.llm.components import components
from ledgerline.session import staged

THRESHOLD = 0.9
TREES, LEAF, SPILL = 10, 192, 0.10
# TREES trees of so many levels miss about this share of the pairs at cosine 0.9; deeper ones are given more trees.
LEVELS, MISSED = 10, 0.001
# The cuts are learnt from at most so many vectors, taken by a hash; all vectors are indexed.
SAMPLE = 16_384
# Most vectors of one side of a comparison; a fuller leaf is compared slice by slice.
TILE = 1_024


@dataclass
class Tree:
    """Cuts by level and node; below the sample's depth all nodes of a level share a direction and cut at their mean."""

    directions: list[np.ndarray]  # level: nodes x dimension
    cuts: list[np.ndarray]
    margins: list[np.ndarray]
    lower: np.ndarray  # further levels x dimension
    lower_margins: np.ndarray  # further levels
    centre: np.ndarray  # node of the last learnt level x dimension

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of every vector; a row may have several."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d, c, m in zip(self.directions, self.cuts, self.margins):
            place = np.einsum("ij,ij->i", x[row], d[node]) - c[node]
            row, node = _sides(row, node, place, m[node])
        top = node
        for direction, margin in zip(self.lower, self.lower_margins):
            place = x[row] @ direction - (self.centre @ direction)[top]
            keep = np.arange(len(row))
            keep, node = _sides(keep, node, place, margin)
            row, top = row[keep], top[keep]
        return row, node


def _sides(row, node, place, margin):
    left, right = place <= margin, place > -margin
    return np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])


def grow(sample: np.ndarray, total: int, seed: int, leaf: int = LEAF, spill: float = SPILL) -> Tree:
    """A tree for `total` vectors, its cuts the medians of the sample's projections."""
    rng = np.random.default_rng(seed)
    depth = max(0, math.ceil(math.log2(max(1, total / leaf))))
    learnt = max(0, min(depth, int(math.log2(max(1, len(sample) / 16)))))
    members = [np.arange(len(sample))]
    directions, cuts, margins = [], [], []
    for _ in range(learnt):
        d = rng.standard_normal((len(members), sample.shape[1]))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        c, m, below = np.zeros(len(members)), np.zeros(len(members)), []
        for i, own in enumerate(members):
            place = sample[own] @ d[i]
            if len(own):
                c[i] = np.median(place)
                m[i] = np.quantile(np.abs(place - c[i]), spill)
            below += [own[place <= c[i]], own[place > c[i]]]
        directions.append(d), cuts.append(c), margins.append(m)
        members = below
    lower = rng.standard_normal((depth - learnt, sample.shape[1]))
    centre = np.stack([sample[own].mean(axis=0) if len(own) else sample.mean(axis=0) for own in members])
    spread = np.zeros(sample.shape)
    for own, middle in zip(members, centre):
        # The mean of few members lies nearer to them than to other vectors of the node.
        spread[own] = (sample[own] - middle) * math.sqrt(len(own) / max(1, len(own) - 1))
    lower_margins = np.array([np.quantile(np.abs(spread @ d), spill) for d in lower])
    return Tree(directions, cuts, margins, lower, lower_margins, centre)


def trees_for(total: int, trees: int = TREES, leaf: int = LEAF) -> int:
    """Trees for `total` vectors: `trees` up to LEVELS cuts, more below, so that a pair is as likely to share a leaf.

    A pair that `trees` trees of LEVELS cuts miss once in 1,000 stays together in one cut with the same chance at every level.
    """
    depth = max(LEVELS, math.ceil(math.log2(max(1, total / leaf))))
    together = (1 - MISSED ** (1 / trees)) ** (depth / LEVELS)
    return math.ceil(math.log(MISSED) / math.log1p(-together) - 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=-1, keepdims=True)  # no overflow in the squares
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors link when their cosine is at least the threshold; every pair that
    shares a leaf of any tree is compared. Equal vectors are one class with a
    count, so copies cost nothing. Vectors of another length than most of the
    sample share one leaf per length. Null, empty and zero vectors, those with
    null or non-finite components, and null ids link with nothing (component: the
    id itself); repeated rows are vectors of their own. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    hashed = staged(rows.withColumn("id", F.when(valid, F.xxhash64("v"))), "vectors")
    classes = hashed.where("id IS NOT NULL").groupBy("id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    classes = staged(classes, "classes")
    total = classes.count()

    chosen = classes.select("id", "v").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample).collect()
    lengths = np.bincount([len(r["v"]) for r in chosen]) if chosen else np.zeros(1, int)
    dimension = int(np.argmax(lengths))
    points = unit(np.array([r["v"] for r in chosen if len(r["v"]) == dimension], float)) if chosen else np.zeros((0, 0))
    forest = [grow(points, total, 100 + t, leaf, spill) for t in range(trees_for(total, trees, leaf))] if len(points) else []
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("v")
        usual = np.array(pc.list_value_length(own).to_numpy(zero_copy_only=False) == dimension)
        codes: list[list[int]] = [[] for _ in range(batch.num_rows)]
        at = np.flatnonzero(usual)
        if len(at):
            x = unit(_matrix(own.filter(pa.array(usual)), dimension))
            for t, tree in enumerate(shared.value):
                for r, node in zip(*(a.tolist() for a in tree.leaves(x))):
                    codes[at[r]].append((t << 48) + node)
        for i in np.flatnonzero(~usual):
            codes[i].append((len(shared.value) << 48) + len(own[i]))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), own, pa.array(codes, pa.list_(pa.int64()))], ["id", "copies", "v", "codes"])

    indexed = staged(map_batches(classes.select("id", "copies", "v"), index, "id long, copies long, v array<double>, codes array<long>"), "index")
    placed = indexed.withColumn("leaf", F.explode("codes"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cut = placed.join(sizes, "leaf").withColumn("slices", F.ceil(F.col("size") / float(TILE)).cast("int"))
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    spread = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    tiles = spread.select("leaf", F.least("slice", "other").alias("x"), F.greatest("slice", "other").alias("y"), "slice", "id", "copies", "v", "codes")

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, threshold)

    found = staged(tiles.groupBy("leaf", "x", "y").applyInArrow(compare, "id long, links long, hub long"), "found")
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    known = classes.select("id", "copies", "first").join(degrees, "id", "left").join(roots, "id", "left")
    known = known.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"), "first")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    out = hashed.select("vec_id", "id").join(known.join(least, "root").select("id", "n_links", "component_id"), "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Of one tile: each vector's links (copies counted) to vectors it first meets here, and the smallest id it hangs together with."""
    leaf, x, y = (table.column(c)[0].as_py() for c in ("leaf", "x", "y"))
    order = np.argsort(table.column("slice").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    ids, copies, part = (table.column(c).to_numpy() for c in ("id", "copies", "slice"))
    own = table.column("v").combine_chunks()
    if len(set(pc.list_value_length(own).to_pylist())) > 1:
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "hub": pa.array([], pa.int64())})
    v = unit(_matrix(own, len(own[0])))
    # Codes below this leaf, padded: two vectors that share one of them have met before.
    lists = [[c for c in l if c < leaf] for l in table.column("codes").to_pylist()]
    earlier = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
    for i, l in enumerate(lists):
        earlier[i, : len(l)] = l
    links, hub, pairs = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    a_side, b_side = np.flatnonzero(part == x), np.flatnonzero(part == y)
    for s in range(0, len(a_side), 256):
        rows = a_side[s : s + 256]
        i, j = np.nonzero(v[rows] @ v[b_side].T >= threshold)
        i, j = rows[i], b_side[j]
        if x == y:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        met = np.zeros(len(i), bool)
        for c in range(earlier.shape[1]):
            code = earlier[i, c]
            met |= (code >= 0) & (earlier[j] == code[:, None]).any(axis=1)
        i, j = i[~met], j[~met]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        pairs.append((i, j))
    for k in range(len(pairs) and len(ids)):  # ends with the longest chain at the latest
        before = hub.copy()
        for i, j in pairs:
            low = np.minimum(hub[i], hub[j])
            np.minimum.at(hub, i, low)
            np.minimum.at(hub, j, low)
        hub = hub[hub]
        if (hub == before).all():
            break
    some = np.flatnonzero(links)
    return pa.table({"id": ids[some], "links": links[some], "hub": ids[hub[some]]})
