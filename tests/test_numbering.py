"""Rows are numbered in one shuffle while no group is long, and frames are staged in one run."""

from pyspark.sql import functions as F

from ledgerline.catalog import common
from ledgerline.operators.skew import number_rows


def test_whole_and_sliced_groups_are_numbered_alike(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("long")).when(F.col("id") % 7 > 0, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.col("id") % 40).alias("day"), "id", (F.col("id") % 9 - 4).alias("x"),
    )
    made = [sorted(number_rows(rows, ["k"], "day", ["id"], "n", {"s": "x"}, whole).collect(), key=repr) for whole in (0, 1000, 10_000)]
    assert made[0] == made[1] == made[2]
    assert len(made[0]) == 5000


def test_short_groups_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 9).alias("k"), (F.col("id") % 40).alias("day"), "id")
        # Beside the rows themselves only counts: one row a group, or one a slice of a long group.
        plan = number_rows(rows, ["k"], "day", ["id"], "n", {}, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__n" not in line]
    assert sum("__key" in line and "__slice" in line for line in wide) <= 2


def test_staging_runs_a_frame_once(spark, monkeypatch, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        ran.add(1)
        return x

    def maker(spark, sf_dir):
        return spark.range(100).select(seen("id").alias("id")).groupBy("id").count()

    monkeypatch.setattr(common.fixtures, "statement_cells", maker)
    common.cells(spark, str(tmp_path)).count()
    assert ran.value == 100
