"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe.

A table hashes a unit vector by pseudo-rotations (random signs and a fast
Hadamard transform, three times) to the nearest signed axis, its cell. A query
looks into the cells of several near axes of every table. What is found is ranked
by the exact inner product of the original vectors. For vectors of different
norms, one more coordinate completes each to the same length, so that the
largest inner products are the nearest directions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm.common import map_batches
from ledgerline.session import staged

TOP, EVERY = 20, 20
# Tables, cells probed of the first polytope, and the share of all cells probed once there are two polytopes.
TABLES, PROBES, SHARE = 10, 10, 1 / 32
# Vectors a cell may hold on average; up to so many distinct vectors are one cell, compared whole.
CELL = 4_096
# Vectors and queries of one comparison; fuller cells are compared slice by slice.
ROW_TILE, QUERY_TILE = 4_096, 1_024
# Norms that differ by less than this share count as equal when cells are chosen (never when ranked).
EVEN = 1e-3
# Rows of one query key that are joined in one group.
SALTED = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, its length a power of two, scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@dataclass
class CrossPolytopes:
    """`tables` hash functions for vectors of one dimension.

    One cell for everything up to `cell` vectors; else the axes of one polytope, and of a second one
    over as many rotated coordinates as it takes to bring the cells down to `cell` vectors.
    """

    dimension: int
    largest: float  # norm
    total: int
    tables: int = TABLES
    probes: int = PROBES
    share: float = SHARE
    cell: int = CELL
    even: bool = True
    seed: int = 13

    def __post_init__(self):
        self.width = 1 << max(0, self.dimension - 1 + (not self.even)).bit_length()
        self.second = 0
        if self.total <= self.cell or self.width < 2:
            self.tables, self.first, self.signs = 1, 0, None
            return
        self.first = self.width
        needed = self.total / (2 * self.first * self.cell)
        if needed > 1:
            self.second = min(self.width, math.ceil(needed / 2) + 1)
        rng = np.random.default_rng(self.seed)
        self.signs = rng.choice([-1.0, 1.0], (self.tables, 2, 3, self.width))

    @property
    def cells(self) -> int:
        return max(1, 2 * self.first) * max(1, 2 * self.second)

    def _axes(self, x: np.ndarray, signs: np.ndarray, axes: int) -> np.ndarray:
        """Nearness to each signed axis: columns 2i and 2i + 1 are axis i against and along."""
        for s in signs:
            x = hadamard(x * s)
        out = np.empty((len(x), 2 * axes))
        out[:, 0::2], out[:, 1::2] = -x[:, :axes], x[:, :axes]
        return out

    def _placed(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of the padded width."""
        x = np.zeros((len(v), self.width))
        norm = _norm(v)
        if self.even or query:
            x[:, : self.dimension] = v / norm[:, None]
        else:
            x[:, : self.dimension] = v / self.largest
            x[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))
        return x

    def codes(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        if not self.first:
            return np.zeros((len(v), 1), np.int64)
        x, out = self._placed(v, False), np.zeros((len(v), self.tables), np.int64)
        for t in range(self.tables):
            out[:, t] = self._axes(x, self.signs[t, 0], self.first).argmax(axis=1)
            if self.second:
                out[:, t] = out[:, t] * 2 * self.second + self._axes(x, self.signs[t, 1], self.second).argmax(axis=1)
        return out

    def probed(self, v: np.ndarray) -> list[np.ndarray]:
        """The cells each query looks into, one array of queries x cells a table."""
        if not self.first:
            return [np.zeros((len(v), 1), np.int64)]
        x, out = self._placed(v, True), []
        for t in range(self.tables):
            near, many = self._axes(x, self.signs[t, 0], self.first), self.probes
            if self.second:
                near = (near[:, :, None] + self._axes(x, self.signs[t, 1], self.second)[:, None, :]).reshape(len(x), -1)
                many = max(many, math.ceil(self.share * self.cells))
            many = min(many, near.shape[1])
            out.append(np.argpartition(-near, many - 1, axis=1)[:, :many])
        return out


def _norm(v: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.abs(v).max(axis=1), np.finfo(float).tiny)  # no overflow in the squares
    return scale * np.sqrt(((v / scale[:, None]) ** 2).sum(axis=1))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding", **index) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of largest inner product found for each row whose id is divisible by `every`.

    Largest first, ties to the smaller id; a query never finds its own id. Null, empty and zero
    vectors, those with null or non-finite components, and null ids take no part. Rows that repeat
    an id and its vector count once; an id with several vectors is a query, and is found, once for
    each (its lists may then be shorter by its own other rows). Vectors are compared with those of their own length only; lengths other than the most
    frequent one are compared whole. A query that finds fewer than `top` rows in its cells is
    compared with all vectors, so it gets all candidates if these are fewer. Equal vectors are
    compared once, whatever their number. Other columns are not read. `index` sets tables, probes,
    share and cell of CrossPolytopes.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    known = rows.where(valid).withColumn("id", F.xxhash64("v"))
    asked = F.col("vec_id") % every == 0
    classes = known.groupBy("id").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.max(asked).alias("asks"))
    classes = staged(classes.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), "classes")
    names = staged(known.select("id", "vec_id").distinct(), "names")
    found_classes = F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.min("norm").alias("fewest")
    usual = classes.groupBy(F.size("v").alias("dimension")).agg(*found_classes).orderBy(F.desc("n"), "dimension").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest, least = usual["most"], usual["fewest"]
    even = not math.isfinite(largest) or largest - least <= EVEN * largest
    hashes = CrossPolytopes(usual["dimension"], largest, usual["n"], even=even, **index)
    shared = spark.sparkContext.broadcast(hashes)

    indexed = staged(map_batches(classes.select("id", "least", "asks", "v"), lambda b: _index(b, shared.value), f"id long, least long, v {classes.schema['v'].dataType.simpleString()}, codes array<long>, probed array<long>"), "index")
    rows_ = indexed.select(F.explode("codes").alias("cell"), "id", "least", "v")
    queries = indexed.where(F.size("probed") > 0).select(F.explode("probed").alias("cell"), "id", "least", "v")
    found = staged(_compared(rows_, queries, top), "found")
    listed = staged(_listed(found, indexed, names, top), "listed")

    # Queries whose cells hold too little meet every vector of their length.
    sizes = indexed.join(names, "id").groupBy(F.size("v").alias("dimension")).agg(F.count(F.lit(1)).alias("held"))
    short = listed.where(F.size("hits") <= top).select("id", F.size("hits").alias("got"))
    short = short.join(indexed.select("id", "least", "v"), "id").withColumn("dimension", F.size("v")).join(sizes, "dimension")
    short = staged(short.where(F.col("got") < F.least(F.col("held"), F.lit(top + 1))).select("id", "least", "v"), "short")
    if not short.isEmpty():
        whole = _compared(indexed.select(F.size("v").cast("long").alias("cell"), "id", "least", "v"), short.select(F.size("v").cast("long").alias("cell"), "id", "least", "v"), top)
        again = _listed(whole, indexed.join(short.select("id"), "id", "left_semi"), names, top)
        listed = listed.join(again.select("id"), "id", "left_anti").unionByName(again)

    # Queries with equal vectors may be many: they are dealt over several copies of their list.
    queries = names.where(asked)
    salts = queries.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / float(SALTED)).cast("int").alias("salts"))
    lists = listed.join(salts, "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = queries.join(salts, "id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    own = dealt.select("id", "salt", F.col("vec_id").alias("query_id")).join(lists.select("id", "salt", "hits"), ["id", "salt"])
    best = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, top)
    return own.select("query_id", F.posexplode(best).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def _index(batch: pa.RecordBatch, hashes: CrossPolytopes) -> pa.RecordBatch:
    """Cells of every vector and, for queries, the cells they probe; a cell's number holds its table."""
    own = batch.column("v")
    lengths = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    codes: list[list[int]] = [[-int(n)] for n in lengths]
    probed: list[list[int]] = [[-int(n)] if asks else [] for n, asks in zip(lengths, batch.column("asks").to_pylist())]
    usual = lengths == hashes.dimension
    at = np.flatnonzero(usual)
    if len(at):
        v = _matrix(own.filter(pa.array(usual)))
        table = np.arange(hashes.tables) << 40
        for i, c in zip(at.tolist(), (hashes.codes(v) + table).tolist()):
            codes[i] = c
        ask = np.flatnonzero([bool(probed[i]) for i in at.tolist()])
        if len(ask):
            cells = np.concatenate([p + t for p, t in zip(hashes.probed(v[ask]), table)], axis=1)
            for i, c in zip(at[ask].tolist(), cells.tolist()):
                probed[i] = c
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("least"), own, pa.array(codes, longs), pa.array(probed, longs)], ["id", "least", "v", "codes", "probed"])


def _compared(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(id, other, least, score): the best classes of each cell for each query that probes it, its own left out."""
    sizes = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("held")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("held") / float(ROW_TILE)).cast("int").alias("xs"), F.ceil(F.col("asked") / float(QUERY_TILE)).cast("int").alias("ys"))

    def spread(side: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        slice_ = F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")
        dealt = side.join(sizes, "cell").withColumn(own, slice_)
        return dealt.select("cell", own, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other), "id", "least", "v", F.lit(query).alias("query")).select("cell", "x", "y", "id", "least", "v", "query")

    tiles = spread(rows, "x", "y", False).unionByName(spread(queries, "y", "x", True))

    def compare(table: pa.Table) -> pa.Table:
        return _best(table, top)

    return tiles.groupBy("cell", "x", "y").applyInArrow(compare, "id long, other long, least long, score double")


def _best(table: pa.Table, top: int) -> pa.Table:
    query = table.column("query").to_numpy()
    ids, least = table.column("id").to_numpy(), table.column("least").to_numpy()
    asks, held = np.flatnonzero(query), np.flatnonzero(~query)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if len(asks) and len(held):
        # Vectors of one cell have one length.
        v = _matrix(table.column("v"))
        order = np.argsort(least[held], kind="stable")
        held = held[order]
        many = min(len(held), top + 2)  # its own class may be among them
        for s in range(0, len(asks), 256):
            a = asks[s : s + 256]
            with np.errstate(all="ignore"):
                near = v[a] @ v[held].T
                bar = np.partition(-near, many - 1, axis=1)[:, many - 1]
                # What ties with the last one but for rounding is ranked, too.
                i, j = np.nonzero(-near <= (bar + 1e-9 * np.abs(bar) + 1e-300)[:, None])
                i, j = a[i], held[j]
                i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
                score = np.concatenate([_products(v[i[k : k + 65_536]], v[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)] or [np.zeros(0)])
            rank = np.lexsort((least[j], -score, i))
            i, j, score = i[rank], j[rank], score[rank]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place <= top
            for column, values in zip(out, (ids[i[keep]], ids[j[keep]], least[j[keep]], score[keep])):
                column.append(values)
    return pa.table({c: np.concatenate(x) for c, x in zip(("id", "other", "least", "score"), out)})


def _listed(found: DataFrame, indexed: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """(id, hits): the best top + 1 rows for each distinct query vector, its own rows among them."""
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = indexed.where(F.size("probed") > 0).select("id", F.col("id").alias("other"), "least", dot.alias("score"))
    both = found.distinct().unionByName(own)
    by_class = W.partitionBy("id").orderBy(F.desc("score"), "least")
    classes = both.withColumn("__n", F.row_number().over(by_class)).where(F.col("__n") <= top + 1).drop("__n")
    # No more of equal vectors than a list can hold.
    few = names.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("vec_id"))).where(F.col("__n") <= top + 1)
    members = few.groupBy(F.col("id").alias("other")).agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    rows = classes.join(members, "other").select("id", "score", F.explode("members").alias("vec_id"))
    best = rows.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).where(F.col("__n") <= top + 1)
    hit = F.struct(F.col("__n").alias("n"), "vec_id", "score")
    return best.groupBy("id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def recall(vectors: DataFrame, found: DataFrame, some: int = 200, top: int = TOP, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """Share of the true nearest rows among those `found`, over `some` queries taken by a hash; they are compared with all vectors."""
    asked = vectors.where(F.col(id_column) % every == 0).orderBy(F.xxhash64(id_column), id_column).limit(some)
    asked = asked.select(F.col(id_column).alias("query_id"), F.col(vector_column).cast("array<double>").alias("q")).collect()
    if not asked:
        return 1.0
    ids, q = np.array([r["query_id"] for r in asked]), np.array([r["q"] for r in asked])
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, near = batch.column("vec_id").to_numpy(), q @ _matrix(batch.column("v")).T
        near[ids[:, None] == own[None, :]] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, :top]
        return pa.RecordBatch.from_arrays([np.repeat(ids, best.shape[1]), own[best].ravel(), np.take_along_axis(near, best, 1).ravel()], ["query_id", "vec_id", "score"])

    true = map_batches(rows, scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = true.withColumn("n", rank).where((F.col("n") <= top) & (F.col("score") > float("-inf")))
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return true.join(hit, ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
