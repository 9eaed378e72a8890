"""Ordered work inside groups that may be arbitrarily large.

A plain window gives a whole group to one task. These helpers split a group
into slices that are ordered among themselves, work inside the slices, and
carry one small row per slice across, so no task ever holds a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICE_ROWS = 65_536


def number_rows(
    df: DataFrame,
    keys: list[str],
    slice_by: str,
    order_by: list[str],
    row_column: str,
    running: dict[str, str] | None = None,
    whole_rows: int = 0,
) -> DataFrame:
    """Zero-based position of every row in its group, plus running sums.

    ``slice_by`` must be a coarse, non-null prefix of the group's order (a day
    of a timestamp order, say). Rows are numbered inside ``keys + slice_by``;
    the slices' own totals, one row each, give the offset. Groups of up to
    ``whole_rows`` rows, where the caller's slices would be no shorter than
    the rows, are one slice. ``running`` maps a new column to the integer column
    whose running sum it holds.
    """
    running = running or {}
    # The keys stand in one struct, which compares null-safe by itself.
    sliced = df.withColumns({"__key": F.struct(*keys), "__slice": F.col(slice_by)})
    counted = sliced
    if whole_rows:
        sizes = sliced.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
        # At most one group in `whole_rows` rows is longer, hence the broadcasts.
        long = sizes.filter(F.col("__n") > whole_rows).select("__key", F.lit(True).alias("__long"))
        counted = sliced.join(F.broadcast(long), "__key", "left_semi")
        sliced = sliced.join(F.broadcast(long), "__key", "left").withColumn("__slice", F.when(F.col("__long"), F.col("__slice")))
    totals = counted.groupBy("__key", "__slice").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(source).alias(f"__t_{name}") for name, source in running.items()],
    )
    earlier = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__key", "__slice",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in running],
    )
    inner = W.partitionBy("__key", "__slice").orderBy(slice_by, *order_by)
    local = sliced.withColumns(
        {"__rn": F.row_number().over(inner) - 1}
        | {
            f"__r_{name}": F.sum(source).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
            for name, source in running.items()
        }
    )
    # Whole groups have no slice and find nothing here.
    joined = local.join(offsets, ["__key", "__slice"], "left")
    out = joined.withColumns(
        {row_column: (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("bigint")}
        | {name: (F.col(f"__r_{name}") + F.coalesce(f"__o_{name}", F.lit(0))).cast("bigint") for name in running}
    )
    return out.select(*df.columns, row_column, *running)


def occurrence_number(df: DataFrame, keys: list[str], position: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """1-based count of a row among the rows of its group, in ``position`` order.

    ``position`` is dense within the file, so slices of it are of bounded size
    even when every row of a huge file shares one key. The keys stand in one
    struct, which compares null-safe by itself: numbering, totals and join then
    share one partitioning. Only what begins in an earlier slice is joined, so the
    join is empty, and left out, while no group is longer than a slice.
    """
    sliced = df.withColumns({"__key": F.struct(*keys), "__slice": F.floor(F.col(position) / slice_rows)})
    earlier = W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy("__key", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    carried = totals.withColumn("__before", F.sum("__n").over(earlier)).filter("__before > 0").drop("__n")
    numbered = sliced.withColumn("__rn", F.row_number().over(W.partitionBy("__key", "__slice").orderBy(position)))
    joined = numbered.join(carried, ["__key", "__slice"], "left")
    return joined.select(*df.columns, (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("bigint").alias(out))


def with_previous(
    df: DataFrame,
    keys: list[str],
    position: str,
    columns: dict[str, str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Values of the previous row of the group, for a dense ``position``.

    ``columns`` maps new column to source column. The last row of each slice is
    copied into the next slice, used there as a predecessor and then dropped, so
    one shuffle by ``keys + slice`` is enough. The result stays partitioned that
    way and keeps the slice number in ``__slice``.
    """
    slot = F.floor(F.col(position) / slice_rows)
    last = F.col(position) % slice_rows == slice_rows - 1
    copies = F.when(last, F.array(slot, slot + 1)).otherwise(F.array(slot))
    spread = df.withColumn("__slice", F.explode(copies))
    order = W.partitionBy(*keys, "__slice").orderBy(position)
    shifted = spread.withColumns({new: F.lag(old).over(order) for new, old in columns.items()})
    return shifted.filter(F.col("__slice") == slot)


def first_rows(condition: Column, position: Column, limit: int) -> Column:
    """Aggregate: the first ``limit`` positions where a condition holds.

    Collects inside the current group, so group by a slice first.
    """
    return F.slice(F.array_sort(F.collect_list(F.when(condition, position))), 1, limit)


def merge_first(lists: str, limit: int) -> Column:
    """Aggregate: fold the per-slice lists of `first_rows` into one."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, limit)
