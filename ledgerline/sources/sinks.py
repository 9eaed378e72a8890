"""Writers."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerline import rules
from ledgerline.functions.text import download_name
from ledgerline.session import staged


def write_documents(parts: DataFrame, files: DataFrame, path: str) -> None:
    """Write statement documents below ``dialect=…/document=<download name>/file_key=…`` folders.

    ``files`` has ``(file_id, file_name)``; the key, a digest of the id, keeps
    files of one name in several folders apart. Parts are range-partitioned and
    sorted, so a long statement is spread over several ordered output files
    instead of passing through one task: those of a folder, in order, are the
    document. Folders of other documents stay as they are. Each part already ends
    its last line, hence the empty line separator is the one Spark would add; it
    is taken off the text first.
    """
    named = parts.join(files.select("file_id", "file_name"), "file_id")
    body = F.regexp_replace("text", "\r\n$", "")
    (
        named.withColumns({"value": body, "document": download_name(F.col("file_name"), F.col("dialect")), "file_key": F.md5("file_id")})
        .repartitionByRange("dialect", "document", "file_key", "part")
        .sortWithinPartitions("dialect", "document", "file_key", "part")
        .select("dialect", "document", "file_key", "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\r\n")
        .partitionBy("dialect", "document", "file_key")
        .text(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(dialect, document, file_key, line_number, line)`` of written documents, lines in order."""
    lines = spark.read.option("lineSep", "\r\n").text(path).select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    order: Column = F.row_number().over(W.partitionBy("dialect", "document", "file_key").orderBy("__file", "__at")) - 1
    return lines.select("dialect", "document", "file_key", order.alias("line_number"), F.col("value").alias("line"))


def append_events(events: DataFrame, path: str) -> None:
    """Append cleaned events to a table partitioned by event date."""
    events.withColumn("event_date", F.to_date("created_at")).write.mode("append").partitionBy("event_date").parquet(path)


def purge_events(spark: SparkSession, path: str, as_of: datetime, days: int = rules.RETENTION_DAYS) -> list[date]:
    """Delete what is older than the retention from a table of `append_events`; the dates that went altogether.

    Whole dates before the border are removed as folders, without reading them.
    The border's date is read, written to the work folder and put in the place of
    the old one. Run again, at any point of a broken run, it gives the same table.
    """
    border = as_of - timedelta(days=days)
    table = spark.read.parquet(path)
    dates = [r["event_date"] for r in table.select("event_date").where(F.col("event_date") <= F.to_date(F.lit(border))).distinct().collect()]
    day = border.astimezone(timezone.utc).date() if border.tzinfo else border.date()
    gone = sorted(d for d in dates if d < day)
    if day in dates:
        on_day = table.where(F.col("event_date") == F.lit(day))
        kept = staged(on_day.where(F.col("created_at") >= F.lit(border)), "kept-events")
        if kept.isEmpty():
            gone.append(day)
        elif kept.count() < on_day.count():
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for d in gone:
        folder = hadoop(f"{path}/event_date={d.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return gone
