"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where a small file would keep them in fewer tasks than there are cores.

    Input of a cluster's size has more partitions than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1000) -> DataFrame:
    """The same table as an unbounded source."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(sf_dir)
    )
