"""Current subscription per user, entitlement, and the rolling allowance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline import rules
from ledgerline.session import staged

STATE = ["customer_id", "subscription_id", "price_id", "status", "current_period_end", "cancel_at_period_end", "change_seq"]


def handled_changes(feed: DataFrame) -> DataFrame:
    """Changes that count; a checkout must name its user and its subscription."""
    known = F.nullif("user_id", F.lit("")).isNotNull() & F.nullif("subscription_id", F.lit("")).isNotNull()
    return feed.filter(F.col("type").isin(rules.HANDLED_CHANGES) & ((F.col("type") != "checkout.session.completed") | known))


def change_records(feed: DataFrame) -> DataFrame:
    """Changes in the shape of the state table; a deletion is ``canceled``."""
    status = F.when(F.col("type") == "customer.subscription.deleted", "canceled").otherwise(F.col("status"))
    return handled_changes(feed).select(
        F.nullif(F.col("user_id"), F.lit("")).alias("user_id"),
        "customer_id",
        "subscription_id",
        "price_id",
        status.alias("status"),
        F.timestamp_seconds("current_period_end_s").alias("current_period_end"),
        "cancel_at_period_end",
        "change_seq",
    )


def _newest(records: DataFrame, key: str) -> DataFrame:
    """The newest record per key, by partial aggregation rather than a window."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), "change_seq").alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def current_subscriptions(feed: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row per user: the newest change wins.

    A change without a user updates the row that holds its subscription id at
    that moment and is dropped when there is none. The row's id is that of its
    newest change with a user, so only later changes of that id matter, and of
    those only the newest.
    """
    records = change_records(feed)
    named = records.filter(F.col("user_id").isNotNull())
    if state is not None:
        named = named.unionByName(state.select("user_id", *STATE))
    base = _newest(named, "user_id")
    loose = _newest(records.filter(F.col("user_id").isNull() & F.col("subscription_id").isNotNull()).drop("user_id"), "subscription_id")
    later = loose.select("subscription_id", F.struct(*[c for c in STATE if c != "subscription_id"]).alias("__u"))
    joined = base.join(later, "subscription_id", "left")
    newer = F.coalesce(F.col("__u.change_seq") > F.col("change_seq"), F.lit(False))
    return joined.select("user_id", *[F.when(newer & F.lit(c != "subscription_id"), F.col(f"__u.{c}") if c != "subscription_id" else F.col(c)).otherwise(F.col(c)).alias(c) for c in STATE])


def touched_users(feed: DataFrame, state: DataFrame | None) -> DataFrame:
    """``user_id`` of every row a batch of changes may write: the users it names, and the holders of the subscriptions it changes without a user."""
    records = change_records(feed)
    named = records.filter(F.col("user_id").isNotNull()).select("user_id")
    if state is None:
        return named.distinct()
    loose = records.filter(F.col("user_id").isNull() & F.col("subscription_id").isNotNull()).select("subscription_id").distinct()
    return named.unionByName(state.select("user_id", "subscription_id").join(loose, "subscription_id", "left_semi").select("user_id")).distinct()


def unmatched_changes(feed: DataFrame) -> DataFrame:
    """Changes without a user that come before any change naming one for their subscription: they are dropped."""
    records = change_records(feed)
    known = records.filter(F.col("user_id").isNotNull()).groupBy("subscription_id").agg(F.min("change_seq").alias("since"))
    loose = records.filter(F.col("user_id").isNull()).join(known, "subscription_id", "left")
    return loose.filter(F.col("since").isNull() | (F.col("change_seq") < F.col("since")))


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch of changes into the state: the keyed rewrite of an upsert."""
    return current_subscriptions(batch, state)


def entitled(status: Column) -> Column:
    return F.coalesce(status.isin(rules.ENTITLED_STATUSES), F.lit(False))


def row_gate(usage: DataFrame, subscriptions: DataFrame, row_count: str = "row_count") -> DataFrame:
    """Whether each conversion may proceed: small files always, large ones when entitled."""
    joined = usage.join(subscriptions.select("user_id", F.col("status").alias("subscription_status")), "user_id", "left")
    allowed = (F.col(row_count) <= rules.FREE_ROW_LIMIT) | entitled(F.col("subscription_status"))
    return joined.withColumn("allowed", allowed)


# --- allowance ---------------------------------------------------------------

DAY_MS = rules.ALLOWANCE_WINDOW_MS


def _active_days(times: DataFrame) -> DataFrame:
    """``(visitor_id, day, first_ms, stretch)``: days with attempts; days that follow each other are one stretch.

    A window lasts a day, so none reaches from one stretch into the next: the
    first attempt of a stretch opens a window. A visitor has one row a day here.
    """
    days = times.groupBy("visitor_id", F.floor(F.col("at_ms") / DAY_MS).alias("day")).agg(F.min("at_ms").alias("first_ms"))
    return days.withColumn("stretch", F.col("day") - F.row_number().over(W.partitionBy("visitor_id").orderBy("day")))


def _pointers(times: DataFrame, days: DataFrame) -> DataFrame:
    """``(visitor_id, at_ms, next_ms)``: where the next window opens if one opens at ``at_ms``, inside the same stretch of days.

    That is the first attempt of the following day at least 24 hours later, or
    the first one of the day after when there is none.
    """
    day = F.floor(F.col("at_ms") / DAY_MS)
    points = times.select("visitor_id", day.alias("day"), F.col("at_ms").alias("x"), F.col("at_ms").alias("point"), F.lit(None).cast("bigint").alias("at_ms"))
    asked = times.select("visitor_id", (day + 1).alias("day"), (F.col("at_ms") + DAY_MS).alias("x"), F.lit(None).cast("bigint").alias("point"), "at_ms")
    backwards = W.partitionBy("visitor_id", "day").orderBy(F.desc("x"), F.desc_nulls_last("point")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = points.unionByName(asked).withColumn("same_day", F.last("point", ignorenulls=True).over(backwards)).filter(F.col("at_ms").isNotNull())
    in_order = W.partitionBy("visitor_id", "stretch").orderBy("day")
    # Rows of the asked day and of the one after it, where the stretch goes on.
    ahead = days.select("visitor_id", "day", F.lead("first_ms").over(in_order).alias("after_ms"))
    joined = found.join(ahead, ["visitor_id", "day"])
    return joined.select("visitor_id", "at_ms", F.coalesce("same_day", "after_ms").alias("next_ms")).filter(F.col("next_ms").isNotNull())


def window_starts(attempts: DataFrame) -> DataFrame:
    """Every allowance window ``(visitor_id, start_ms)``.

    Windows of a stretch of days are the orbit of its first attempt under the
    pointers. Orbits are marked by pointer doubling: in round k the marks jump 2^k
    windows ahead, so rounds grow with the logarithm of the longest stretch, and no
    visitor is ever collected. Only first attempts of days and targets of pointers
    can open a window; pointers of all others are dropped at once.
    """
    times = staged(attempts.select("visitor_id", "at_ms").distinct(), "attempt-times")
    days = staged(_active_days(times), "active-days")
    first = days.groupBy("visitor_id", "stretch").agg(F.min("first_ms").alias("start_ms")).select("visitor_id", "start_ms")
    pointers = staged(_pointers(times, days), "pointers")
    nodes = days.select("visitor_id", F.col("first_ms").alias("at_ms")).unionByName(pointers.select("visitor_id", F.col("next_ms").alias("at_ms"))).distinct()
    jumps, marked = staged(pointers.join(nodes, ["visitor_id", "at_ms"]), "jumps"), staged(first, "marked")
    while not jumps.isEmpty():
        ahead = marked.join(jumps, (marked["visitor_id"] == jumps["visitor_id"]) & (marked["start_ms"] == jumps["at_ms"])).select(marked["visitor_id"], F.col("next_ms").alias("start_ms"))
        marked = staged(marked.unionByName(ahead).distinct(), "marked")
        onward = jumps.select("visitor_id", F.col("at_ms").alias("next_ms"), F.col("next_ms").alias("further_ms"))
        jumps = staged(jumps.join(onward, ["visitor_id", "next_ms"]).select("visitor_id", "at_ms", F.col("further_ms").alias("next_ms")), "jumps")
    return marked


def meter_allowance(attempts: DataFrame, limit: int = rules.ALLOWANCE_LIMIT) -> DataFrame:
    """Outcome of every attempt ``(visitor_id, attempt_id, at_ms)`` in time order.

    A window opens at the first granted attempt and lasts 24 hours; its first
    ``limit`` attempts are granted, the others refused without spending.
    """
    day = F.floor(F.col("at_ms") / DAY_MS)
    starts = window_starts(attempts)
    first_day = F.floor(F.col("start_ms") / DAY_MS)
    # A window touches its own day and the next, which makes this an equi-join.
    reach = starts.select("visitor_id", "start_ms", F.explode(F.array(first_day, first_day + 1)).alias("day"))
    placed = (
        attempts.select("visitor_id", "attempt_id", "at_ms", day.alias("day"))
        .join(reach, ["visitor_id", "day"])
        .filter((F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") - F.col("start_ms") < DAY_MS))
        .drop("day")
    )
    rank = F.row_number().over(W.partitionBy("visitor_id", "start_ms").orderBy("at_ms", "attempt_id"))
    used = F.least(F.col("rank"), F.lit(limit))
    return placed.withColumn("rank", rank).select(
        "visitor_id",
        "attempt_id",
        "at_ms",
        (F.col("rank") <= limit).alias("allowed"),
        used.alias("used"),
        (F.lit(limit) - used).alias("remaining"),
        (F.col("start_ms") + DAY_MS).alias("resets_at_ms"),
    )


def peek_allowance(metered: DataFrame, at_ms: int, limit: int = rules.ALLOWANCE_LIMIT) -> DataFrame:
    """Each visitor's allowance at a time, spending nothing."""
    seen = metered.filter(F.col("at_ms") <= at_ms)
    last = seen.groupBy("visitor_id").agg(F.max_by(F.struct("used", "resets_at_ms"), F.struct("at_ms", "attempt_id")).alias("s"))
    live = F.col("s.resets_at_ms") > at_ms
    used = F.when(live, F.col("s.used")).otherwise(F.lit(0))
    return last.select(
        "visitor_id",
        (used < limit).alias("allowed"),
        used.alias("used"),
        (F.lit(limit) - used).alias("remaining"),
        F.when(live, F.col("s.resets_at_ms")).alias("resets_at_ms"),
    )


def peek_attempts(attempts: DataFrame, at_ms: int, limit: int = rules.ALLOWANCE_LIMIT) -> DataFrame:
    """`peek_allowance` from the attempts themselves, of which only those that can matter are metered.

    A window that is open at a time opened on that day or the day before, in the
    stretch of days that reaches there. All earlier stretches, and all visitors
    who were not there on these two days, are left out.
    """
    seen = attempts.filter(F.col("at_ms") <= at_ms)
    days = staged(_active_days(seen.select("visitor_id", "at_ms")), "active-days")
    last = days.groupBy("visitor_id").agg(F.max_by(F.struct("day", "stretch"), "day").alias("last"))
    recent = F.col("last.day") >= at_ms // DAY_MS - 1
    live = last.filter(recent).join(days, "visitor_id").filter(F.col("stretch") == F.col("last.stretch"))
    since = live.groupBy("visitor_id").agg(F.min("first_ms").alias("since"))
    wanted = seen.join(since, "visitor_id").filter(F.col("at_ms") >= F.col("since")).drop("since")
    out = peek_allowance(meter_allowance(wanted, limit), at_ms, limit)
    full = last.filter(~recent).select("visitor_id", F.lit(limit > 0).alias("allowed"), F.lit(0).alias("used"), F.lit(limit).alias("remaining"), F.lit(None).cast("bigint").alias("resets_at_ms"))
    return out.unionByName(full)
