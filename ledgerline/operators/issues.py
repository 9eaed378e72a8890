"""Folding issue rows into readable checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline import rules
from ledgerline.functions.classify import issue_label, issue_status

CHECK = ["file_id", "ordinal", "check_id", "label", "status", "detail"]


def fold_issues(issues: DataFrame) -> DataFrame:
    """One check per file-level issue, and one per row-level code with a count.

    ``issues`` needs ``ordinal``, the order of the file-level findings; row
    issues come after them in order of their first row. Row issues are counted
    by a partial aggregate, so a file with millions of bad rows folds cheaply.
    """
    per_row = F.col("code").isin(rules.PER_ROW_CODES)
    label, status = issue_label(F.col("code")), issue_status(F.col("level"))
    position = F.row_number().over(W.partitionBy("file_id").orderBy("ordinal", "code")) - 1
    single = (
        issues.filter(~per_row)
        .withColumn("position", position)
        .select(
            "file_id",
            F.col("position").cast("bigint").alias("ordinal"),
            F.concat_ws("-", F.lit("worker"), F.col("code"), F.col("position").cast("string")).alias("check_id"),
            label.alias("label"),
            status.alias("status"),
            F.col("message").alias("detail"),
        )
    )
    grouped = (
        issues.filter(per_row)
        .groupBy("file_id", "code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row").alias("first_row"),
            F.min_by("message", "row").alias("message"),
            F.min_by("level", "row").alias("level"),
        )
    )
    many = F.col("n") > 1
    folded = grouped.select(
        "file_id",
        (F.col("first_row") + 1_000_000).alias("ordinal"),
        F.concat(F.lit("worker-"), F.col("code"), F.lit("-grouped")).alias("check_id"),
        F.when(many, F.concat(label, F.lit(" ("), F.col("n"), F.lit(" rows)"))).otherwise(label).alias("label"),
        status.alias("status"),
        F.when(many, F.concat(F.col("n"), F.lit(" rows were skipped for this reason. First: "), F.col("message"))).otherwise(F.col("message")).alias("detail"),
    )
    return single.unionByName(folded)
