"""Literal cases of the parsers, and the skew helpers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, money, text
from ledgerline.operators import identity, skew
from ledgerline.operators.columns import resolve_contention
from ledgerline.operators.subscriptions import current_subscriptions, meter_allowance

MONEY = {
    "0.1": 10, "0.2": 20, "0.30": 30, "1,234.50": 123450, "$1,000": 100000, "92233720368547758.07": 9223372036854775807, "(45.60)": -4560, "123.45-": -12345,
    "100.00 DR": -10000, "100.00 CR": 10000, "0.005": 1, "99.999": 10000, "0.004": 0, "": None, "0.00": 0, "1 234,56": None, "1,23": None, "1,5": None, "1,23456": None,
    "1,234,567.89": 123456789, "12345.67": 1234567, "(-5.00)": 500, "100.00DR": None, "abc": None, "-": None, ".": None, "0.0049999999": 0, "EUR 20.00": 2000, "9" * 45: None,
}


def test_money(spark):
    df = spark.createDataFrame([(k,) for k in MONEY], "raw string")
    got = money.with_minor_units(df, {"m": "raw"}, F.lit("."), F.lit(","), F.lit(2)).collect()
    assert {r.raw: None if r.m is None else int(r.m) for r in got} == MONEY


DATES = {"01/03/2025": ("2025-01-03", "2025-03-01"), "17 Jan 2025": ("2025-01-17", "2025-01-17"), "2025-01-05T10:00:00": (None, None), "2025-01-05 10:00:59": ("2025-01-05", "2025-01-05"),
         "20250105": ("2025-01-05", "2025-01-05"), "30/02/2025": (None, None), "29/02/2024": (None, "2024-02-29"), "1/2/70": ("1970-01-02", "1970-02-01"), "Sept 3, 25": ("2025-09-03", "2025-09-03"),
         "4-NOT SPECIFIED": (None, None), "0/1/2020": (None, None), "": (None, None), "1/2/123": (None, None)}


def test_dates_and_date_predicate(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "raw string")
    parts = dates.with_date_parts(df, "raw", "p")
    got = parts.select("raw", "p_is_date", dates.is_date_text(F.col("raw")).alias("fast"), dates.date_from_parts("p", F.lit("MDY")).cast("string"), dates.date_from_parts("p", F.lit("DMY")).cast("string")).collect()
    assert {r[0]: (r[3], r[4]) for r in got} == DATES
    assert all(r.p_is_date == r.fast for r in got)


def test_markup(spark):
    rows = spark.createDataFrame([("Café “x” — €5 <b>\u0001ok\t\n z",), ("A" * 31 + "&b",), ("한 が",)], "t string")
    got = [r[0] for r in rows.select(text.markup_text(F.col("t"), 32)).collect()]
    assert got == ['Cafe "x" - EUR5 &lt;b&gt;ok z', "A" * 31, "??? ??"]


def test_occurrences_in_small_slices(spark):
    random.seed(1)
    rows = [("f", i, random.choice("aab")) for i in range(500)]
    df = spark.createDataFrame(rows, "file_id string, source_row bigint, base string")
    got = {r.source_row: r.nth for r in skew.occurrence_number(df, ["file_id", "base"], "source_row", "nth", slice_rows=7).collect()}
    seen = {}
    for _, i, b in rows:
        seen[b] = seen.get(b, 0) + 1
        assert got[i] == seen[b]


def test_occurrences_of_missing_keys(spark):
    rows = [("f", i, None if i % 3 else "a") for i in range(60)] + [(None, i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "file_id string, source_row bigint, base string")
    got = sorted((r.file_id or "", r.base or "", r.source_row, r.nth) for r in skew.occurrence_number(df, ["file_id", "base"], "source_row", "nth", slice_rows=7).collect())
    seen, want = {}, []
    for f, i, b in rows:
        seen[f, b] = seen.get((f, b), 0) + 1
        want.append((f or "", b or "", i, seen[f, b]))
    assert got == sorted(want)


def test_ids_need_two_scans_and_four_exchanges(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("'f' AS file_id", "id AS source_row", "CAST(id % 9 AS string) AS base").write.parquet(path)
    plan = skew.occurrence_number(spark.read.parquet(path), ["file_id", "base"], "source_row", "nth")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Exchange hashpartitioning") <= 4


def test_previous_in_small_slices(spark):
    df = spark.createDataFrame([("f", i, i * i) for i in range(100)], "file_id string, source_row bigint, x bigint")
    got = {r.source_row: r.prev for r in skew.with_previous(df, ["file_id"], "source_row", {"prev": "x"}, slice_rows=7).collect()}
    assert got == {i: None if i == 0 else (i - 1) ** 2 for i in range(100)}


def test_contention(spark):
    draft = [("f", 0, "a", "description", 0.45, True), ("f", 1, "b", "description", 1.0, True), ("f", 2, "c", "description", 0.5, True), ("f", 3, "d", "amount", 0.5, False), ("f", 4, "e", "amount", 0.5, False)]
    df = spark.createDataFrame([(a, b, c, d, e, False, g) for a, b, c, d, e, g in draft], "file_id string, col_index int, header string, role string, confidence double, user_assigned boolean, textual boolean")
    got = [r.role for r in resolve_contention(df).orderBy("col_index").collect()]
    assert got == ["memo", "description", "ignored", "amount", "ignored"]


def test_ids_are_append_stable(spark):
    rows = [("f", "A", i, "2025-01-05", -320, 2, "X", None) for i in range(3)]
    schema = "file_id string, account_id string, source_row bigint, d string, m bigint, scale int, name string, memo string"

    def ids(data):
        df = spark.createDataFrame(data, schema).select("*", F.to_date("d").alias("date_posted"), F.col("m").cast(money.MINOR).alias("amount_minor"))
        return [r.fit_id for r in identity.with_fit_ids(df).orderBy("source_row").collect()]

    first = ids(rows)
    assert first[1:] == [f"{first[0]}-2", f"{first[0]}-3"]
    assert ids(rows + [("f", "A", 3, "2025-02-09", -320, 2, "X", None)])[:3] == first


def brute_allowance(attempts):
    state, out = {}, {}
    for v, i, t in sorted(attempts, key=lambda a: (a[2], a[1])):
        start, used = state.get(v, (None, 0))
        if start is None or t - start >= 86_400_000:
            start, used = t, 0
        ok = used < 2
        used += ok
        state[v] = (start, used)
        out[i] = (ok, used, start + 86_400_000)
    return out


def _attempts(seed):
    """Visitors with gaps, with attempts on every day for weeks, and with attempts a millisecond around a day apart."""
    rng = random.Random(seed)
    day = 86_400_000
    times = [(v, rng.randrange(40 * day)) for v in range(4) for _ in range(30)]
    times += [(10, d * day + rng.randrange(day)) for d in range(37) for _ in range(rng.randint(1, 4))]
    times += [(11, d * day + 5 * d) for d in range(33)] + [(12, 33 * day - d * (day + 3)) for d in range(33)] + [(13, d * day) for d in range(20)]
    times += [(14, d * day + e) for d in range(12) for e in (-1, 0, 1)] + [(15, 7)] * 5
    return [(v, i, t) for i, (v, t) in enumerate(times)]


def test_allowance_windows(spark):
    attempts = _attempts(2)
    df = spark.createDataFrame(attempts, "visitor_id bigint, attempt_id bigint, at_ms bigint")
    got = {r.attempt_id: (r.allowed, r.used, r.resets_at_ms) for r in meter_allowance(df).collect()}
    assert got == brute_allowance(attempts)


def test_a_peek_needs_the_last_days_only(spark):
    from ledgerline.operators import subscriptions as subs

    attempts = _attempts(3)
    df = spark.createDataFrame(attempts, "visitor_id bigint, attempt_id bigint, at_ms bigint")
    for at in (0, 12 * 86_400_000 + 5, 33 * 86_400_000, 80 * 86_400_000):
        assert sorted(subs.peek_attempts(df, at).collect()) == sorted(subs.peek_allowance(meter_allowance(df), at).collect())


def test_a_moved_user_keeps_only_the_new_subscription(spark):
    def change(seq, user, sub, status):
        return (seq, "customer.subscription.updated", user, "c", sub, "p", status, None, False)

    feed = [change(1, None, "s1", "active"), change(2, "u", "s1", "trialing"), change(3, None, "s1", "past_due"), change(4, "u", "s2", "active"), change(5, None, "s1", "unpaid")]
    df = spark.createDataFrame(feed, "change_seq bigint, type string, user_id string, customer_id string, subscription_id string, price_id string, status string, current_period_end_s bigint, cancel_at_period_end boolean")
    assert [(r.user_id, r.subscription_id, r.status) for r in current_subscriptions(df).collect()] == [("u", "s2", "active")]
    assert current_subscriptions(df.filter("change_seq <= 3")).first().status == "past_due"


def test_no_python_in_row_plans(spark, sf):
    from ledgerline import catalog

    for name in ("n07_money", "m01_clean_events", "i02_fit_ids"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_allowance_of_any_size(spark):
    from ledgerline.operators.subscriptions import meter_allowance

    attempts = spark.createDataFrame([(1, i, i * 1000) for i in range(6)], "visitor_id long, attempt_id long, at_ms long")
    rows = meter_allowance(attempts, limit=4).orderBy("attempt_id").collect()
    assert [(r.allowed, r.used, r.remaining) for r in rows] == [(True, 1, 3), (True, 2, 2), (True, 3, 1), (True, 4, 0), (False, 4, 0), (False, 4, 0)]


def test_checkouts_must_name_user_and_subscription(spark):
    from ledgerline.operators.subscriptions import change_records

    schema = "type string, user_id string, customer_id string, subscription_id string, price_id string, status string, current_period_end_s long, cancel_at_period_end boolean, change_seq long"
    done, changed = "checkout.session.completed", "customer.subscription.updated"
    rows = [(done, None, "c", "s", None, "active", None, False, 1), (done, "u", "c", None, None, "active", None, False, 2), (done, "u", "c", "s", None, "active", None, False, 3), (changed, None, "c", "s", None, "active", None, False, 4)]
    assert [r.change_seq for r in change_records(spark.createDataFrame(rows, schema)).orderBy("change_seq").collect()] == [3, 4]


def test_a_range_prunes_the_partitions(spark, tmp_path):
    import datetime

    from ledgerline.operators.telemetry import purge, range_scan
    from ledgerline.sources.sinks import append_events

    path = str(tmp_path / "events")
    append_events(spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("created_at")), path)
    for found in (range_scan(spark.read.parquet(path), datetime.datetime(1970, 2, 9), 24), purge(spark.read.parquet(path), datetime.datetime(1970, 2, 9), 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date" in plan.split("PartitionFilters")[1]
        assert found.count() == 2


def test_common_money_shapes_read_like_the_steps(spark, monkeypatch):
    """Every combination of sign, mark, parentheses and suffix, read at once where the shape is common, and by the steps alone."""
    from itertools import product

    from ledgerline.functions import money

    numbers = ["1,234.56", "1234.56", "0.00", "12,34.56", "1.234,56", "123456789012345.67", "1,234,567.89", "5.5", "7", "1.005"]
    made = ["".join(x) for x in product(["", " ", "-", "+", "- ", "(", "(-", "( ", "$", "-$", "$-", "USD ", "- USD ", "-USD ", "(USD ", "EUR", "€ ", "(-€"], numbers, ["", " ", ")", " )", "-", " -", "+", " DR", "DR", " CR", "- DR", "-DR", " USD", "USD", " dr", ") DR", " C"])]
    rows = [(c, d, g, n) for c in made for d, g in ((".", ","), (",", "."), (".", None)) for n in (2, 0)]
    df = spark.createDataFrame(rows, "cell string, point string, comma string, scale int")

    def read():
        return money.with_minor_units(df, {"minor": "cell"}, F.col("point"), F.col("comma"), F.col("scale")).collect()

    quick = read()
    fast = df.select(money._common_minor(F.col("cell"), F.col("point"), F.col("comma"), F.col("scale")).alias("x")).where("x IS NOT NULL").count()
    monkeypatch.setattr(money, "_common_minor", lambda *a: F.lit(None).cast("bigint"))
    differ = [(a, b.minor) for a, b in zip(quick, read()) if a.minor != b.minor]
    assert not differ and fast > 500, differ[:5]
