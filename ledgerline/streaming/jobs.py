"""The same operators on unbounded input.

Each function starts one query and returns it; ``available_now`` drains what is
there and stops, which is how the tests compare a stream with its batch twin.
The late-data bound of one hour is a choice of this library.

A watermark only moves with newer events, so what the last hours hold stays
open. `with_clock` adds a second source to a stream, and `tick` writes a time to
it: the watermark passes everything before that time, and the open windows close.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerline import rules
from ledgerline.operators.subscriptions import current_subscriptions, touched_users
from ledgerline.operators.telemetry import clean_events, visitor_key

LATENESS = "1 hour"


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_events(raw: DataFrame, checkpoint: str, path: str, available_now: bool = False) -> StreamingQuery:
    """Clean events and append them to a table partitioned by event date."""
    out = clean_events(raw).withColumn("event_date", F.to_date("created_at"))
    return _start(out.writeStream.format("parquet").option("path", path).partitionBy("event_date").outputMode("append"), checkpoint, available_now)


def with_clock(stream: DataFrame, time: str, clock: str) -> DataFrame:
    """A stream with the ticks of a clock folder as rows that have nothing but a ``time``."""
    spark = stream.sparkSession
    kind = stream.schema[time].dataType
    ticks = spark.readStream.schema("tick timestamp").parquet(clock).select(F.col("tick").cast(kind).alias(time))
    return stream.unionByName(ticks, allowMissingColumns=True)


def tick(spark: SparkSession, clock: str, time) -> None:
    """Let the clock pass a time; later events from before it are late."""
    spark.createDataFrame([(time,)], "tick timestamp").write.mode("append").parquet(clock)


def start_clock(spark: SparkSession, clock: str) -> None:
    """An empty clock folder, to be made before a stream reads it."""
    spark.createDataFrame([], "tick timestamp").write.mode("append").parquet(clock)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", LATENESS)


def hourly_counts(events: DataFrame) -> DataFrame:
    """Tumbling hours, closed by the watermark."""
    return (
        _timed(events)
        .groupBy(F.window("created_at", "1 hour").alias("w"))
        .agg(F.count_if(F.col("event") == "visitor_landed").alias("landed"), F.count_if(F.col("event") == "conversion_success").alias("converted"))
        .select(F.col("w.start").alias("hour_start"), "landed", "converted")
    )


# Sketches of 2^12 registers: the standard error of a count is 1.04 / sqrt(2^12), 1.6 %.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def hourly_visitors(events: DataFrame) -> DataFrame:
    """One mergeable sketch of the visitors of every hour; an event belongs to one hour only."""
    landed = F.when(F.col("event") == "visitor_landed", visitor_key())
    return (
        _timed(events)
        .groupBy(F.window("created_at", "1 hour").alias("w"))
        .agg(F.hll_sketch_agg(landed, F.lit(SKETCH_BITS)).alias("sketch"))
        .select(F.col("w.start").alias("hour_start"), "sketch")
    )


def rolling_visitors(hourly: DataFrame, hours: int = rules.DEFAULT_RANGE_HOURS, slide: int = 1) -> DataFrame:
    """Unique visitors of sliding ranges, from the hours' sketches: ``(range_start, range_end, visitors)``.

    Ranges of ``hours`` start at every ``slide``-th hour since the epoch; each hour's sketch
    is merged into the ranges it lies in, so what is copied grows with hours, not with events.
    """
    first = F.unix_seconds("hour_start") / 3600
    low = F.ceil((first - hours + 1) / slide).cast("long")
    start = F.explode(F.sequence(low, F.greatest(low, F.floor(first / slide).cast("long"))))
    placed = hourly.select(start.alias("at"), first.alias("first"), "sketch").where((F.col("at") * slide <= F.col("first")) & (F.col("at") * slide > F.col("first") - hours))
    merged = placed.groupBy("at").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors")).where("visitors > 0")
    begin = F.col("at") * slide * 3600
    return merged.select(F.timestamp_seconds(begin).alias("range_start"), F.timestamp_seconds(begin + hours * 3600).alias("range_end"), "visitors")


def hourly_rollup(events: DataFrame) -> DataFrame:
    """What the dashboards need of an hour: ``(hour_start, event, error_code, events, sessions, visitors)``.

    One row an hour, event and error code, appended when the hour closes; sessions
    and visitors are sketches, which merge over hours. See `operators.rollup`.
    """
    code = F.when(F.col("event") == "conversion_failed", F.coalesce("error_code", F.lit(rules.UNKNOWN_ERROR)))
    return (
        _timed(events.withColumn("code", code))
        .groupBy(F.window("created_at", "1 hour").alias("w"), "event", "code")
        .agg(
            F.count("event").alias("events"),
            F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)).alias("sessions"),
            F.hll_sketch_agg(visitor_key(), F.lit(SKETCH_BITS)).alias("visitors"),
        )
        # Ticks count as none. A filter on the event itself would be pushed below the watermark, which must see them.
        .where(F.col("events") > 0)
        .select(F.col("w.start").alias("hour_start"), "event", F.col("code").alias("error_code"), "events", "sessions", "visitors")
    )


def first_passes(events: DataFrame) -> DataFrame:
    """One ``preflight_pass`` per session, the first time it is seen."""
    passes = _timed(events).filter(F.col("event") == "preflight_pass")
    return passes.dropDuplicatesWithinWatermark(["session_id", "event"])


def write_table(out: DataFrame, checkpoint: str, path: str, available_now: bool = False) -> StreamingQuery:
    return _start(out.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, available_now)


ALLOWANCE_OUT = "visitor_id bigint, attempt_id bigint, at_ms bigint, allowed boolean, used int, remaining int, resets_at_ms bigint"


class Allowance(StatefulProcessor):
    """One visitor's open window, and the attempts whose time the watermark has not passed yet.

    Attempts wait in a map by their millisecond, each with a timer. Timers fire in
    the order of time, so attempts are decided as the batch operator decides them,
    whatever micro-batches bring them in which order. Another timer clears the
    window when it has ended.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, used int")
        self.waiting = handle.getMapState("waiting", "at_ms bigint", "attempts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            at = (row.at_ms,)
            held = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else []
            if not held:
                self.handle.registerTimer(row.at_ms)
            self.waiting.updateValue(at, ([*held, row.attempt_id],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        start, used = self.window.get() if self.window.exists() else (None, 0)
        over = start is None or at - start >= rules.ALLOWANCE_WINDOW_MS
        if not self.waiting.containsKey((at,)):
            if over and self.window.exists():
                self.window.clear()
            return
        attempts = sorted(self.waiting.getValue((at,))[0])
        self.waiting.removeKey((at,))
        if over:
            start, used = at, 0
            self.handle.registerTimer(start + rules.ALLOWANCE_WINDOW_MS)
        for attempt in attempts:
            granted = used < rules.ALLOWANCE_LIMIT
            used += granted
            yield Row(
                visitor_id=key[0], attempt_id=attempt, at_ms=at, allowed=granted, used=used,
                remaining=rules.ALLOWANCE_LIMIT - used, resets_at_ms=start + rules.ALLOWANCE_WINDOW_MS,
            )
        self.window.update((start, used))

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def metered_attempts(attempts: DataFrame) -> DataFrame:
    """Allowance per visitor as keyed state with event-time timers, which the RocksDB store holds.

    An attempt is decided when the watermark passes it; rows later than one hour
    are left out by Spark. Equal to `meter_allowance` over all rows that are not.
    `attempts` may hold ticks: rows with a time ``at`` only.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at = F.timestamp_millis("at_ms")
    timed = attempts.withColumn("at", F.coalesce(F.col("at"), at) if "at" in attempts.columns else at).withWatermark("at", LATENESS)
    # The time is named so that ticks get as far as the watermark.
    asked = timed.where(F.col("attempt_id").isNotNull() & F.col("at").isNotNull() | F.col("at").isNull()).select("visitor_id", "attempt_id", "at_ms", "at")
    return asked.groupBy("visitor_id").transformWithState(Allowance(), ALLOWANCE_OUT, "Append", "EventTime")


# Parts of the subscription state: a batch rewrites those its users are in.
STATE_PARTS = 64


def _part():
    return F.pmod(F.xxhash64("user_id"), F.lit(STATE_PARTS)).cast("int")


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version that holds each part of the state; at most STATE_PARTS entries.

    A manifest is one file, which is there as a whole or not at all, and it is written
    after the parts it names.
    """
    if before is None or before > 0:
        listed = spark.read.schema("version long, parts array<struct<part: int, version: long>>").option("recursiveFileLookup", "true").json(f"{path}/manifest")
        if before is not None:
            listed = listed.where(F.col("version") < before)
        newest = listed.agg(F.max_by("parts", "version")).first()[0]
        return {r["part"]: r["version"] for r in newest or []}
    return {}


def _read_parts(spark: SparkSession, path: str, parts: dict[int, int]) -> DataFrame | None:
    if not parts:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}/part={p}" for p, v in sorted(parts.items())]).drop("version", "part")


def fold_subscriptions(path: str, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch into the state below ``path``: only the parts it touches are written again."""
    spark = batch.sparkSession
    if batch_id == 0:
        spark.createDataFrame([], "version long, parts array<struct<part: int, version: long>>").write.mode("overwrite").json(f"{path}/manifest/version=start")
    known = _manifest(spark, path, batch_id)
    state = _read_parts(spark, path, known)
    touched = sorted(r["part"] for r in touched_users(batch, state).select(_part().alias("part")).distinct().collect())
    merged = current_subscriptions(batch, _read_parts(spark, path, {p: known[p] for p in touched if p in known}))
    # A change without a user may name a subscription whose row lies in a part the batch does not touch only if there is no such row.
    merged.withColumn("part", _part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={batch_id}")
    parts = [(p, batch_id if p in touched else known[p]) for p in sorted({*known, *touched})]
    row = spark.createDataFrame([(batch_id, parts)], "version long, parts array<struct<part: int, version: long>>")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={batch_id}")


def upsert_subscriptions(feed: DataFrame, checkpoint: str, path: str, available_now: bool = False) -> StreamingQuery:
    """Keep one current row per user below ``path``, in parts by user and versions by micro-batch.

    A batch that is run again after a failure starts from the manifest before it and
    writes the same version.
    """
    return _start(feed.writeStream.foreachBatch(lambda batch, batch_id: fold_subscriptions(path, batch, batch_id)).outputMode("append"), checkpoint, available_now)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The current rows, as the newest manifest names them."""
    return _read_parts(spark, path, _manifest(spark, path))


def convert_landed_files(files: DataFrame, checkpoint: str, path: str, available_now: bool = False) -> StreamingQuery:
    """Convert each newly landed file. Ids depend on file and account only, so a
    batch that is run again writes the same transactions to the same folder."""
    from ledgerline.plans.convert import convert_files
    from ledgerline.sources.tables import spread

    def convert(batch: DataFrame, batch_id: int) -> None:
        # A few landed files with many rows are a few tasks; deal them out before the long steps.
        _, conversion = convert_files(spread(batch))
        conversion.transactions.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(files.writeStream.foreachBatch(convert).outputMode("append"), checkpoint, available_now)
