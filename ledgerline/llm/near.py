"""From MinHash keys of distinct sets to verified links and components.

Only components are wanted, so no group is expanded into all its pairs. First
each set is compared with the smallest one under a key (its hub), for the two of
its hubs that promise most; the links found join most copies, and such rounds go
on while they join more. Then only sets under one key whose components still
differ are compared: few under most keys, so a join whose condition bounds the
overlap; many under a frequent passage, so in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import shingles
from ledgerline.llm.common import give_back, map_batches
from ledgerline.llm.components import components
from ledgerline.session import staged

# Up to this many sets under one key are paired by a join; above it, tiles hold about TILE hashes a slice.
PAIRED, TILE = 24, 1 << 20
# Bytes of a tile after which a worker gives freed memory back.
LARGE = 4 << 20
# Texts are looked up by up to this many ids sent to every executor; beyond it both sides are shuffled.
SENT_IDS = 500_000
# Hub rounds go on while each leaves at most this share of the memberships apart.
SHRINKS = 0.8


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set of `rows` (id, n, keys, bits, narrow): copies meet here, aggregated before the shuffle."""
    firsts = [F.first(c).alias(c) for c in ("n", "keys", "bits", "narrow")]
    return staged(rows.where("id IS NOT NULL").groupBy("id").agg(*firsts), "classes")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, id, hub) of the keys that more than one id has; `keyed` has (key, id), repeats allowed."""
    ends = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    return staged(keyed.join(ends, "key").distinct(), "members")


def near_components(members: DataFrame, sets: DataFrame, arrays_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, root) of every set with a link to another one.

    `members`: key, id, hub. `sets`: id, n, bits, narrow of all these ids. `arrays_of(ids)`:
    (id, own) with the sorted hashes as bytes for the ids asked for.
    """
    own_root = members.select("key", "id", "hub", F.col("id").alias("root"), F.col("hub").alias("hub_root"))
    found = verified(_to_hubs(own_root), sets, arrays_of, percent)
    before = None
    while True:
        rooted = staged(_rooted(members, found), "rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.min(F.struct("root", "id")).alias("h"))
        open_ = rooted.join(mixed.where("low < high").select("key", "size", F.col("h.id").alias("hub"), F.col("h.root").alias("hub_root")), "key")
        open_ = staged(open_, "open")
        left = open_.count()
        # Once more for what is still apart: the hub is now in the smallest component under the key.
        if before is not None and left > SHRINKS * before or not left:
            break
        before = left
        more = verified(_to_hubs(open_), sets, arrays_of, percent)
        if more.isEmpty():
            break
        found = found.unionByName(more)

    # Signatures meet their set once, then go under its keys.
    keyed = open_.groupBy("id").agg(F.first("root").alias("root"), F.collect_list(F.struct("key", "size")).alias("under"))
    few = keyed.select("id", "root", F.filter("under", lambda u: u["size"] <= PAIRED).alias("under")).where(F.size("under") > 0).join(sets.select("id", "n", "narrow"), "id")
    few = few.select(F.explode("under.key").alias("key"), "id", "root", "n", "narrow")

    def side(c: str) -> DataFrame:
        return few.select("key", F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("root", "n", "narrow")])

    pairs = side("a").join(side("b"), "key").where(_may_link(percent)).select("a", "b")
    rest = verified(pairs.distinct(), sets, arrays_of, percent)
    found = found.unionByName(rest)
    many = keyed.select("id", "root", F.filter("under", lambda u: u["size"] > PAIRED).alias("under")).where(F.size("under") > 0)
    if not many.isEmpty():
        own = staged(arrays_of(many.select("id")), "sets")
        whole = many.join(sets.select("id", "n", "bits"), "id").join(own, "id")
        found = found.unionByName(tile_links(whole.select(F.explode("under.key").alias("key"), "id", "root", "n", "bits", "own"), percent))
    return components(found)


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = staged(components(links), "roots")
    return members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))


def _to_hubs(members: DataFrame) -> DataFrame:
    """(a, b): each set with two of the hubs it is apart from, the one it shares most keys with and the smallest."""
    hubs = members.where("root <> hub_root").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("shared"))
    best = hubs.groupBy("id").agg(F.max_by("hub", F.struct("shared", "hub")).alias("nearest"), F.min("hub").alias("least"))
    return best.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("nearest", "least"))).alias("b"))


def _may_link(percent: int) -> str:
    """Join condition: in different components, and neither sizes nor 256-bit signatures rule the link out."""
    only = {x: " + ".join(f"bit_count(narrow_{x}[{i}] & ~narrow_{y}[{i}])" for i in range(4)) for x, y in ("ab", "ba")}
    shared = f"least(n_a - ({only['a']}), n_b - ({only['b']}))"
    return f"a < b AND root_a <> root_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND (100 + {percent}) * {shared} >= {percent} * (n_a + n_b)"


def verified(pairs: DataFrame, sets: DataFrame, arrays_of, percent: int) -> DataFrame:
    """The pairs that link: sizes, then the bitmap bound, then the exact intersection of sorted arrays."""

    def side(c):
        return sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b = (batch.column(f"n_{c}").to_numpy(zero_copy_only=False) for c in "ab")
        only = np.zeros((2, batch.num_rows), np.int64)
        for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            x, y = shingles.fold(x, len(y)), shingles.fold(y, len(x))
            only[0, i], only[1, i] = np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()
        keep = shingles.links(n_a, n_b, shingles.overlap_bound(n_a, n_b, only[0], only[1]), percent)
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in "ab"], ["a", "b"])

    likely = staged(map_batches(sized, bounded, "a long, b long"), "likely")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    own = staged(arrays_of(wanted), "sets")
    with_a = likely.join(own.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a")
    both = with_a.join(own.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("own_a").to_pylist(), batch.column("own_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(bool(shingles.links(len(x), len(y), shingles.shared_count(x, y), percent)))
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    return staged(map_batches(both, exact, "a long, b long"), "verified")


def tile_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of sets under one key; `members`: key, id, root, n, bits, own.

    A tile is a key, a size band and two slices of at most about TILE hashes.
    Bands grow by 100 / percent, so linked sets are in one band or in neighbouring
    ones: a set goes to its own band's tiles and, as the smaller side, to the next
    one's. In a tile bit counts bound the overlap, the rest is intersected exactly,
    and sets that already hang together are not compared: a tile gives fewer links
    than it has sets, however many pairs link.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    sides = members.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("lower")).withColumn("tile", band + F.col("lower"))
    sizes = sides.groupBy("key", "tile").agg(F.sum("n").alias("hashes"), F.min("lower").alias("smallest"), F.count(F.lit(1)).alias("sets"))
    # A tile without sets of its own band has nothing to compare its smaller sets with.
    sizes = sizes.where("smallest = 0 AND sets > 1").select("key", "tile", F.ceil(F.col("hashes") / float(TILE)).cast("int").alias("slices"))
    cut = sides.join(sizes, ["key", "tile"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    spread = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    spread = spread.select("key", "tile", F.least("slice", "other").alias("x"), F.greatest("slice", "other").alias("y"), "slice", "lower", "id", "root", "n", "bits", "own")

    def compare(table: pa.Table) -> pa.Table:
        n, ids = table.column("n").to_numpy(), table.column("id").to_numpy()
        low, part = table.column("lower").to_numpy(), table.column("slice").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        label = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        own = [np.frombuffer(b, np.uint64) for b in table.column("own").to_pylist()]
        bits = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        width = min(map(len, bits))
        signs = np.stack([shingles.fold(b, width) for b in bits]).view(np.uint64)
        count = np.bitwise_count(signs).sum(axis=1).astype(np.int64)
        a, b = [], []
        for i in np.flatnonzero(low == 0):
            # Each pair of sets meets in exactly one tile: across the two slices, or inside one where x = y.
            may = (label != label[i]) & ((low == 1) | (ids > ids[i])) & (((part == x) & (part[i] == y)) | ((part == y) & (part[i] == x)))
            at = np.flatnonzero(may & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if not len(at):
                continue
            both = np.bitwise_count(signs[at] & signs[i]).sum(axis=1).astype(np.int64)
            bound = shingles.overlap_bound(n[at], n[i], count[at] - both, count[i] - both)
            for j in at[shingles.links(n[at], n[i], bound, percent)]:
                if label[j] != label[i] and shingles.links(n[j], n[i], shingles.shared_count(own[j], own[i]), percent):
                    label[label == label[j]] = label[i]
                    a.append(ids[i]), b.append(ids[j])
        if table.nbytes >= LARGE:
            del own, bits, signs
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("key", "tile", "x", "y").applyInArrow(compare, "a long, b long")
