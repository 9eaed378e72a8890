"""The bank-layout dimension: twenty rows, broadcast onto facts of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline import rules
from ledgerline.functions.classify import literal_map
from ledgerline.operators.columns import layout_headers, preset_roles


def layouts(spark: SparkSession) -> DataFrame:
    data = [x[:7] for x in rules.BANK_LAYOUTS]
    df = spark.createDataFrame(
        data, "bank_slug string, bank_name string, product string, region string, date_order string, amount_mode string, confidence string"
    ).withColumn("last_verified", F.lit(None).cast("string"))
    return df.withColumns(
        {
            "account_kind": F.try_element_at(literal_map(rules.ACCOUNT_KINDS), F.col("product")),
            "verified": (F.col("confidence") == "verified") & F.col("last_verified").isNotNull(),
            "last_reviewed": F.coalesce("last_verified", F.lit(rules.LAYOUTS_COMPILED_ON)),
        }
    )


def enrich(facts: DataFrame, slug: str = "bank_slug") -> DataFrame:
    """Facts with the layout of their slug; unknown slugs keep NULLs."""
    dimension = layouts(facts.sparkSession).withColumnRenamed("bank_slug", slug)
    return facts.join(F.broadcast(dimension), slug, "left")


def gate(facts: DataFrame, level: str, slug: str = "bank_slug") -> DataFrame:
    """Facts whose layout is ``publishable``, ``reviewed`` or ``unverified``."""
    dimension = layouts(facts.sparkSession)
    publishable = F.col("verified")
    condition = {"publishable": publishable, "reviewed": F.col("confidence") != "unverified", "unverified": ~publishable}[level]
    kept = dimension.filter(condition).select(F.col("bank_slug").alias(slug))
    return facts.join(F.broadcast(kept), slug, "left_semi")


def market(region: Column) -> Column:
    return F.when(region == "UK", "UK").when(region == "EU", "EU").otherwise("US")


def market_currency(region: Column) -> Column:
    return F.try_element_at(literal_map(rules.MARKET_CURRENCY), market(region))


def with_market(facts: DataFrame) -> DataFrame:
    region = F.col("region")
    return facts.withColumns({"market": market(region), "market_currency": market_currency(region), "uk_or_eu": market(region) != "US"})


def declared_columns(spark: SparkSession) -> DataFrame:
    """Every declared column with the role it is pre-selected as."""
    resolved = preset_roles(layout_headers(spark), ["bank_slug"], "position", "layout_role")
    return resolved.select(
        "bank_slug", (F.col("position") + 1).alias("position"), "header", "header_key", F.coalesce("preset_role", F.lit("detected from content")).alias("preselected")
    )


def compare_layouts(mapping: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against observed columns of every file with a declared layout."""
    from ledgerline.functions.text import layout_key

    spark = mapping.sparkSession
    expected = declared.join(F.broadcast(declared_columns(spark)), "bank_slug")
    observed = mapping.select("file_id", layout_key(F.col("header")).alias("header_key"), F.col("role").alias("observed_role"), "col_index")
    joined = expected.join(observed, ["file_id", "header_key"], "left")
    return joined.select(
        "file_id", "bank_slug", "position", "header", "preselected", "observed_role", F.col("observed_role").isNotNull().alias("present")
    )
