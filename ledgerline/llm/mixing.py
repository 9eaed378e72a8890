"""Mixing sources to target weights with a hypergeometric splitting tree, in native expressions.

Each source is a line of words: its documents in hashed order, end to end, as
often as a document may repeat. Its target cuts the line, and the line is cut
into blocks of `block_words`. The exact number of blocks of every source is
split among output shards by a binary tree; at each node the left half draws
its blocks of each source from the multivariate hypergeometric distribution.
Shards then take disjoint ranges of each source's permuted blocks and shuffle
their documents. Every draw hangs on a hash, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.llm.common import word_count
from ledgerline.operators.skew import number_rows
from ledgerline.session import staged

WEIGHTS, SHARE_PERCENT, CAP = (5, 2, 1), 150, 2
BLOCK_WORDS, SHARD_BLOCKS = 16_384, 64
# Rows that share a slice of a source's hashed order, on average.
SLICE_ROWS = 4_096
# A prime above any number of blocks: block * PRIME mod n permutes n blocks.
PRIME = 2_147_483_647
# Levels of the tree between two written tables.
LEVELS = 6


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, rank, source_size, target), one row a source; only such rows meet in one task.

    Sources by code point, null last, take the weights in turn and share
    `share_percent` of all sizes. A target stops at `cap` times its source's
    size; the excess goes to the others by weight until none is above. In order
    of cap / weight the stopped sources come first: one stops if the level at
    which it would be full is reached before the share is used up.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = total.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = ranked.withColumns({"weight": w, "full": F.col("source_size") * cap}).withColumns(
        {"level": F.col("full").cast("double") / F.col("weight"), "share": F.sum("source_size").over(everything) * share_percent / 100.0, "weights": F.sum("weight").over(everything)}
    )
    before = W.orderBy("level", "rank").rowsBetween(W.unboundedPreceding, -1)
    stops = F.coalesce(F.sum("full").over(before), F.lit(0)) + F.col("level") * (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))) <= F.col("share")
    marked = sized.withColumn("stops", stops)
    used = F.sum(F.when(F.col("stops"), F.col("full")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    level = F.try_divide(F.col("share") - used, open_weight.cast("double"))
    return marked.withColumn("target", F.when(F.col("stops"), F.col("full").cast("double")).otherwise(level * F.col("weight"))).select(
        "source", "rank", "source_size", "target"
    )


def _uniform(*parts) -> Column:
    """A hash as a number above 0 and below 1."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def _hypergeometric(marked: Column, drawn: Column, total: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among `marked` ones, by inversion at `u`.

    Relative weights start at 1 at the mode and follow the ratio of neighbours to
    both sides, as far as ten deviations: what is beyond is below double precision.
    """
    p = F.struct(marked.cast("double").alias("k"), drawn.cast("double").alias("n"), total.cast("double").alias("t"), u.alias("u"))

    def draw(p: Column) -> Column:
        k, n, t = p["k"], p["n"], p["t"]
        low, high = F.greatest(F.lit(0.0), n + k - t), F.least(k, n)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")))
        spread = F.ceil(10 * F.sqrt(n * k / t * (t - k) / t * (t - n) / F.greatest(t - 1, F.lit(1.0)) + 1)).cast("double")
        up = F.least(high - mode, spread).cast("int")
        down = F.least(mode - low, spread).cast("int")

        def steps(count: Column) -> Column:
            return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

        def rise(x: Column) -> Column:  # weight of x over weight of x - 1
            return (k - x + 1) * (n - x + 1) / (x * (t - k - n + x))

        def fall(x: Column) -> Column:  # weight of x over weight of x + 1
            return (x + 1) * (t - k - n + x + 1) / ((k - x) * (n - x))

        def side(count: Column, ratio) -> Column:
            """Sum of the weights on one side of the mode."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            grow = lambda s, i: F.struct((s["w"] * ratio(i)).alias("w"), (s["sum"] + s["w"] * ratio(i)).alias("sum"))
            return F.aggregate(steps(count), start, grow, lambda s: s["sum"])

        def find(count: Column, ratio, left: Column) -> Column:
            """First step at which the weights have used up `left`; the last one at least."""
            start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), F.lit(0).alias("at"))

            def walk(s: Column, i: Column) -> Column:
                w = s["w"] * ratio(i)
                return F.struct(w.alias("w"), F.when(s["left"] > 0, s["left"] - w).otherwise(s["left"]).alias("left"), F.when(s["left"] > 0, i).otherwise(s["at"]).alias("at"))

            return F.aggregate(steps(count), start, walk, lambda s: s["at"])

        rising, falling = side(up, lambda i: rise(mode + i)), side(down, lambda i: fall(mode - i))
        sums = F.array(F.struct(rising.alias("r"), falling.alias("f")))

        def pick(s: Column) -> Column:
            mark = p["u"] * (1 + s["r"] + s["f"])
            above = mode + find(up, lambda i: rise(mode + i), mark - 1)
            below = mode - find(down, lambda i: fall(mode - i), mark - 1 - s["r"])
            return F.when(mark <= 1, mode).when((mark <= 1 + s["r"]) & (up > 0), above).otherwise(below)

        return F.transform(sums, pick)[0]

    # A struct in an array of one: its fields are computed once.
    return F.when((drawn <= 0) | (marked <= 0), F.lit(0)).when(drawn >= total, marked).otherwise(F.transform(F.array(p), draw)[0]).cast("long")


def shard_quotas(targets: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, rank, position): the shard of every permuted block of every source.

    A node holds the shards [low, high), the blocks left of each source and where
    they begin in the source's permuted order; children inherit both, so no
    running sum over shards is needed. Rows double with each level and are dealt
    out again between written tables.
    """
    blocks = F.ceil(F.round("target") / block_words).cast("long")
    lists = targets.select(F.struct("rank", blocks.alias("blocks")).alias("x")).groupBy().agg(F.array_sort(F.collect_list("x")).alias("x"))
    root = lists.select(F.transform("x", lambda s: s["blocks"]).alias("quota"), F.transform("x", lambda s: F.lit(0).cast("long")).alias("begin"))
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q)
    root = root.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.greatest(F.ceil(total / shard_blocks), F.lit(1)).cast("long"))
    nodes = staged(root, "tree")
    first = nodes.first()
    depth = math.ceil(math.log2(first["high"])) if first else 0
    for level in range(depth):
        nodes = _split(nodes, seed)
        if level % LEVELS == LEVELS - 1 and level < depth - 1:
            nodes = staged(nodes.repartition("low"), "tree")
    leaves = nodes.select(F.col("low").alias("shard"), F.posexplode(F.arrays_zip("quota", "begin")).alias("rank", "x"))
    ranges = leaves.where("x.quota > 0").select("shard", "rank", F.explode(F.sequence(F.col("x.begin"), F.col("x.begin") + F.col("x.quota") - 1)).alias("position"))
    return ranges


def _split(nodes: DataFrame, seed: int) -> DataFrame:
    """One level: nodes of several shards become two."""
    size = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q)
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
    part = F.floor(size * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
    state = F.struct(part.alias("draw"), size.alias("rest"), F.array().cast("array<bigint>").alias("left"))

    def one(s: Column, q: Column) -> Column:
        u = _uniform(F.lit(seed), F.col("low"), F.col("high"), F.size(s["left"]))
        taken = F.transform(F.array(_hypergeometric(q, s["draw"], s["rest"], u)), lambda k: F.struct((s["draw"] - k).alias("draw"), (s["rest"] - q).alias("rest"), F.concat(s["left"], F.array(k)).alias("left")))
        return taken[0]

    drawn = F.when(F.col("high") - F.col("low") > 1, F.aggregate("quota", state, one, lambda s: s["left"])).otherwise(F.col("quota"))
    split = nodes.withColumns({"left": drawn, "middle": F.when(F.col("high") - F.col("low") > 1, middle).otherwise(F.col("high"))})
    halves = F.array(
        F.struct("low", F.col("middle").alias("high"), F.col("left").alias("quota"), F.col("begin")),
        F.struct(
            F.col("middle").alias("low"),
            F.col("high"),
            F.zip_with("quota", "left", lambda q, k: q - k).alias("quota"),
            F.zip_with("begin", "left", lambda b, k: b + k).alias("begin"),
        ),
    )
    return split.select(F.explode(halves).alias("h")).select("h.quota", "h.begin", "h.low", "h.high").where("low < high")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Every turn of every document on its source's line, with what the mix takes of it.

    Returns doc_id, source, copy (rows alike in id, source and size are numbered),
    turn (from 0, below `cap`), size, source_size, target, words (0 if the turn
    lies beyond the target; the turn on which the target falls is cut), shard and
    place in the shard (null if nothing is taken). Null text has no words and is
    never taken; null sources are one source; null ids are hashed as such; empty
    tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column)).alias("size"))
    entries = staged(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    targets = staged(source_targets(entries, weights, share_percent, cap), "targets")

    digits = max(1, math.ceil(math.log(max(1, entries.count() / SLICE_ROWS), 16)))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = entries.withColumns({"key": key, "run": F.col("size") * F.col("copies")}).withColumn("slice", F.substring("key", 1, digits))
    lined = number_rows(keyed, ["source"], "slice", ["key", "doc_id", "size"], "number", {"line_end": "run"})
    known = lined.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copied = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    turned = copied.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    start = F.col("line_end") - F.col("run") + F.col("copy") * F.col("size") + F.col("turn") * F.col("source_size")
    goal = F.round("target").cast("long")
    turned = turned.withColumn("start", start).withColumn("wanted", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - F.col("start"))))
    blocks = F.ceil(F.round("target") / block_words).cast("long")
    block = F.floor(F.col("start") / block_words)
    turned = turned.withColumn("position", F.when(F.col("wanted") > 0, (block * PRIME + F.hash(F.lit(seed), F.col("rank")).cast("long") + 2**31) % blocks))
    dealt = turned.join(shard_quotas(targets, block_words, shard_blocks, seed), ["rank", "position"], "left")
    words = F.when(F.col("shard").isNotNull(), F.col("wanted")).otherwise(F.lit(0).cast("long"))
    in_shard = W.partitionBy("shard", (F.col("shard").isNull()).cast("int"), F.when(F.col("shard").isNull(), F.xxhash64("key"))).orderBy(F.xxhash64(F.lit(seed), "key", "copy", "turn"))
    place = F.when(F.col("shard").isNotNull(), F.row_number().over(in_shard) - 1)
    return dealt.withColumn("words", words).withColumn("place", place).select(
        "doc_id", "source", "copy", "turn", "size", "source_size", "target", "words", "shard", "place"
    )


def amounts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row."""
    drawn = mix(docs, **options).groupBy("doc_id", "source", "size", "copy", "source_size", "target").agg(F.sum("words").alias("taken"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (id, text, source among them) as the mix takes them: once, twice or not at all.

    The one row of a source on which its target falls keeps its first words only.
    """
    taken = mix(docs, **options).where("words > 0").groupBy("doc_id", "source", "size", "copy").agg(F.collect_list("words").alias("takes"))
    same = W.partitionBy("__d", "__s", "__n").orderBy("__h")
    named = docs.withColumns({"__d": F.col("doc_id"), "__s": F.col("source").cast("string"), "__n": word_count(F.col("text")), "__h": F.xxhash64("text")})
    numbered = named.withColumn("__c", F.row_number().over(same) - 1)
    keys = taken.select(F.col("doc_id").alias("__td"), F.col("source").alias("__ts"), F.col("size").alias("__tn"), F.col("copy").alias("__tc"), "takes")
    joined = numbered.join(
        keys, F.col("__d").eqNullSafe(F.col("__td")) & F.col("__s").eqNullSafe(F.col("__ts")) & (F.col("__n") == F.col("__tn")) & (F.col("__c") == F.col("__tc"))
    )
    out = joined.withColumn("__words", F.explode("takes"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    return out.withColumn("text", F.when(F.col("__words") < F.col("__n"), cut).otherwise(F.col("text"))).select(*docs.columns)
