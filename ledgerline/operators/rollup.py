"""The dashboards from the hourly roll-up that a stream keeps, without a look at the events.

Rows are ``(hour_start, event, error_code, events, sessions, visitors)``. Ranges
begin and end at full hours. Counts are exact; distinct numbers come from merged
sketches (`streaming.jobs.SKETCH_ERROR` is their standard error).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from ledgerline import rules


def hours_until(rollup: DataFrame, as_of: datetime, hours: int = rules.DEFAULT_RANGE_HOURS) -> DataFrame:
    """The rows of the last hours, the current one among them."""
    last = as_of.replace(minute=0, second=0, microsecond=0, tzinfo=as_of.tzinfo or timezone.utc)
    return rollup.filter(F.col("hour_start").between(F.lit(last - timedelta(hours=hours - 1)), F.lit(last)))


def _number(event: str):
    return F.coalesce(F.sum(F.when(F.col("event") == event, F.col("events"))), F.lit(0))


def counters(rollup: DataFrame) -> DataFrame:
    return rollup.agg(_number("conversion_success").alias("successes"), _number("conversion_failed").alias("failures"), _number("user_logged_in").alias("logins"))


def _distinct(sketch: str):
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0))


def unique_visitors(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("event") == "visitor_landed").agg(_distinct("visitors").alias("unique_visitors"))


def funnel(rollup: DataFrame) -> DataFrame:
    """Distinct sessions per stage, in the shape of `telemetry.funnel`."""
    stages = rollup.sparkSession.createDataFrame([(i, label, event) for i, (label, event) in enumerate(rules.FUNNEL)], "stage int, label string, event string")
    seen = rollup.groupBy("event").agg(_distinct("sessions").alias("sessions"))
    return stages.join(seen, "event", "left").select("stage", "label", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def failure_ranking(rollup: DataFrame) -> DataFrame:
    failed = rollup.filter(F.col("event") == "conversion_failed")
    return failed.groupBy("error_code").agg(F.sum("events").alias("failures")).orderBy(F.desc("failures"), "error_code")


def hourly_buckets(rollup: DataFrame, as_of: datetime, slots: int = 24) -> DataFrame:
    """The last hours, empty ones included, in the shape of `telemetry.hourly_buckets`."""
    current = as_of.replace(minute=0, second=0, microsecond=0, tzinfo=None)
    counted = hours_until(rollup, as_of, slots).groupBy(F.date_format("hour_start", "yyyy-MM-dd HH:00").alias("hour")).agg(_number("visitor_landed").alias("landed"), _number("conversion_success").alias("converted"))
    start = F.lit(current - timedelta(hours=slots - 1)).cast("timestamp_ntz")
    spine = rollup.sparkSession.range(slots).select(F.date_format(start + F.make_dt_interval(F.lit(0), F.col("id").cast("int")), "yyyy-MM-dd HH:00").alias("hour"))
    return spine.join(counted, "hour", "left").select("hour", F.coalesce("landed", F.lit(0)).alias("landed"), F.coalesce("converted", F.lit(0)).alias("converted"))
