"""Streams over several micro-batches against their batch twins."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.subscriptions import current_subscriptions, meter_allowance
from ledgerline.streaming import jobs

HOUR = 3_600_000


def _utc(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)


def test_late_attempts_over_several_batches(spark, tmp_path):
    """Attempts come up to an hour late, out of order inside and across micro-batches; the result is that of the batch operator."""
    rng = random.Random(7)
    base = 1_700_000_000_000
    rows = [(rng.randrange(4), i, base + rng.randrange(4 * 24 * HOUR)) for i in range(300)]
    rows += [(9, 1000 + i, base + 5 * HOUR) for i in range(5)]  # one millisecond
    # Events of half an hour reach the stream together, each up to 50 minutes late.
    arrive = sorted(rows, key=lambda r: r[2] + rng.randrange(50 * 60_000))
    batches = [arrive[i : i + 61] for i in range(0, len(arrive), 61)]
    schema = "visitor_id bigint, attempt_id bigint, at_ms bigint"
    jobs.start_clock(spark, f"{tmp_path}/clock")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_millis("at_ms"))

    def run():
        jobs.write_table(jobs.metered_attempts(jobs.with_clock(feed, "at", f"{tmp_path}/clock")), f"{tmp_path}/checkpoint", f"{tmp_path}/out", available_now=True).awaitTermination()
        return spark.read.schema(jobs.ALLOWANCE_OUT).parquet(f"{tmp_path}/out").count()

    counts = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts.append(run())
    jobs.tick(spark, f"{tmp_path}/clock", _utc(base + 10 * 24 * HOUR))
    counts.append(run())
    assert counts == sorted(counts) and counts[-2] < len(rows) == counts[-1]
    columns = ["visitor_id", "attempt_id", "at_ms", "allowed", "used", "remaining", "resets_at_ms"]
    got = spark.read.schema(jobs.ALLOWANCE_OUT).parquet(f"{tmp_path}/out").select(*columns)
    want = meter_allowance(spark.createDataFrame(rows, schema)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The timers have cleared every window and every waiting attempt.
    state = spark.read.format("statestore").option("stateVarName", "window").load(f"{tmp_path}/checkpoint")
    assert state.where("value IS NOT NULL").count() == 0


def test_open_hours_close_with_the_clock(spark, tmp_path):
    schema = "event string, created_at timestamp, ip string, session_id string"
    start = datetime.datetime(2025, 1, 1, 10, tzinfo=datetime.timezone.utc)
    rows = [("visitor_landed", start + datetime.timedelta(minutes=20 * i), f"10.0.0.{i % 5}", None) for i in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    jobs.start_clock(spark, f"{tmp_path}/clock")
    feed = jobs.with_clock(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "created_at", f"{tmp_path}/clock")

    def run():
        jobs.write_table(jobs.hourly_counts(feed), f"{tmp_path}/checkpoint", f"{tmp_path}/out", available_now=True).awaitTermination()
        return sorted((r.hour_start.hour, r.landed) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(10, 3), (11, 3)]
    jobs.tick(spark, f"{tmp_path}/clock", start + datetime.timedelta(hours=8))
    assert run() == [(10, 3), (11, 3), (12, 3), (13, 3)]


def _changes(seqs_users):
    """(seq, user or None, subscription, status)"""
    return [("customer.subscription.updated", user, f"c{sub}", f"sub_{sub}", "p", status, 1_800_000_000, False, seq) for seq, user, sub, status in seqs_users]


CHANGES = "type string, user_id string, customer_id string, subscription_id string, price_id string, status string, current_period_end_s bigint, cancel_at_period_end boolean, change_seq bigint"


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    path, seq = f"{tmp_path}/state", 0
    batches = [_changes([(i, f"u{i}", i, "active") for i in range(400)])]
    batches.append(_changes([(1000 + i, f"u{i * 7}", i * 7, "past_due") for i in range(5)] + [(1100 + i, None, i * 11, "canceled") for i in range(5)] + [(1200, None, 9999, "active")]))
    batches.append(_changes([(2000, "new", 5000, "trialing"), (2001, None, 5000, "active")]))
    frames = [spark.createDataFrame(b, CHANGES) for b in batches]
    for k, frame in enumerate(frames):
        jobs.fold_subscriptions(path, frame, k)
    parts = [[d for d in os.listdir(f"{path}/data/version={k}") if d.startswith("part=")] for k in range(3)]
    assert len(parts[0]) == jobs.STATE_PARTS and 1 < len(parts[1]) <= 10 and len(parts[2]) == 1

    def rows(df):
        return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)

    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    want = rows(current_subscriptions(whole))
    assert rows(jobs.latest_version(spark, path)) == want
    # A version without a manifest is not read, and running its batch again gives the same state.
    frames[0].limit(3).write.parquet(f"{path}/data/version=3/part=0")
    os.makedirs(f"{path}/manifest/version=3/_temporary")
    with open(f"{path}/manifest/version=3/_temporary/part-0.json", "w") as f:
        json.dump({"version": 3, "parts": [{"part": 0, "version": 3}]}, f)
    assert rows(jobs.latest_version(spark, path)) == want
    jobs.fold_subscriptions(path, frames[2], 2)
    assert rows(jobs.latest_version(spark, path)) == want


@pytest.mark.parametrize("hours,slide", [(24, 1), (24, 6), (36, 24)])
def test_rolling_visitors_from_hourly_sketches(spark, hours, slide):
    """Few visitors are counted exactly by the sketches, in the ranges of Spark's own windows."""
    start = datetime.datetime(2025, 1, 1, 3, tzinfo=datetime.timezone.utc)
    rng = random.Random(2)
    rows = [("visitor_landed", start + datetime.timedelta(minutes=rng.randrange(6000)), f"v{rng.randrange(20)}", None) for _ in range(200)]
    events = spark.createDataFrame(rows, "event string, created_at timestamp, ip string, session_id string")
    found = jobs.rolling_visitors(jobs.hourly_visitors(events), hours, slide)
    exact = events.groupBy(F.window("created_at", f"{hours} hours", f"{slide} hours").alias("w")).agg(F.count_distinct("ip").alias("n")).select("w.start", "w.end", "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_dashboards_read_the_rollup_only(spark, tmp_path):
    from ledgerline.operators import rollup, telemetry

    start = datetime.datetime(2025, 1, 1)
    rng = random.Random(4)
    kinds = ["visitor_landed", "file_loaded", "preflight_pass", "conversion_success", "conversion_failed", "user_logged_in"]
    rows = [(rng.choice(kinds), start + datetime.timedelta(minutes=rng.randrange(3000)), f"10.0.0.{rng.randrange(9)}", f"s{rng.randrange(30)}", rng.choice([None, "bad-date"])) for _ in range(500)]
    events = spark.createDataFrame(rows, "event string, created_at timestamp_ntz, ip string, session_id string, error_code string")
    now = start + datetime.timedelta(minutes=2990)
    jobs.hourly_rollup(events).write.parquet(f"{tmp_path}/rollup")
    table = spark.read.parquet(f"{tmp_path}/rollup")
    whole = rollup.hours_until(table, now, 100)
    pairs = [
        (rollup.counters(whole), telemetry.counters(events)), (rollup.unique_visitors(whole), telemetry.unique_visitors(events)),
        (rollup.funnel(whole), telemetry.funnel(events)), (rollup.failure_ranking(whole), telemetry.failure_ranking(events)),
        (rollup.hourly_buckets(table, now), telemetry.hourly_buckets(events, now)),
    ]
    for quick, direct in pairs:
        assert sorted(map(tuple, quick.select(*direct.columns).collect())) == sorted(map(tuple, direct.collect()))
        assert quick.inputFiles() and all("/rollup/" in f for f in quick.inputFiles())
