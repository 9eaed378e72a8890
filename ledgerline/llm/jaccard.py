"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Documents with equal sets of five-word shingles are one class. Classes meet
under MinHash keys (60 bands of 4: a pair at Jaccard 0.75 is missed with
probability 2e-10, at 0.9 with 1e-28; no key, partner or candidate is capped),
in tiles of a key and a size band, where bit counts of hashed signatures bound
the overlap from above before sorted arrays are intersected exactly. See near.py.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import shingles
from ledgerline.llm.common import binaries, map_batches, utf8
from ledgerline.llm.near import SENT_IDS, classes, near_components, shared_keys
from ledgerline.session import staged

PERCENT, BANDS, ROWS = 75, 60, 4


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Two documents link when 100 * shared >= percent * union of their sets of
    shingles; component_id is the smallest id reachable by links, itself
    included. Null, empty and blank texts have an empty set and link with
    nothing. A null id is linked with nothing and has a null component. Rows
    that repeat an id are documents of their own. Other columns are not read.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    band = shingles.Bands(bands, rows)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shingles.shingle_sets(binaries(batch.column("text")))
        some = [len(s) > 0 for s in own]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([shingles.set_id(s) if ok else None for s, ok in zip(own, some)], pa.int64()),
                pa.array([len(s) for s in own], pa.int64()),
                pa.array([band.keys(s) if ok else None for s, ok in zip(own, some)], pa.list_(pa.int64())),
                pa.array([shingles.bitmap(s) if ok else None for s, ok in zip(own, some)], pa.binary()),
                pa.array([shingles.narrow(s) if ok else None for s, ok in zip(own, some)], pa.list_(pa.int64())),
            ],
            ["doc_id", "id", "n", "keys", "bits", "narrow"],
        )

    rows_ = staged(map_batches(texts, sketch, "doc_id long, id long, n long, keys array<long>, bits binary, narrow array<long>"), "sketch")
    linked = rows_.where("doc_id IS NOT NULL")
    sets = classes(linked)

    def arrays_of(ids: DataFrame) -> DataFrame:
        named = linked.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
        wanted = named.join(ids, "id", "left_semi").select("doc_id", F.col("id").alias("wanted"))
        found = texts.join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, "doc_id")

        def own(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets_ = shingles.shingle_sets(binaries(batch.column("text")))
            # A repeated id may bring other texts along: only the wanted set counts.
            keep = [len(s) > 0 and shingles.set_id(s) == w for s, w in zip(sets_, batch.column("wanted").to_pylist())]
            ids_ = batch.column("wanted").filter(pa.array(keep, pa.bool_()))
            return pa.RecordBatch.from_arrays([ids_, pa.array([s.tobytes() for s, k in zip(sets_, keep) if k], pa.binary())], ["id", "own"])

        return map_batches(found, own, "id long, own binary").dropDuplicates(["id"])

    members = shared_keys(sets.select(F.explode("keys").alias("key"), "id"))
    roots = near_components(members, sets, arrays_of, percent)
    firsts = linked.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("id", "component_id")
    out = rows_.select("doc_id", "id", F.col("n").alias("n_shingles")).join(named, "id", "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"))
