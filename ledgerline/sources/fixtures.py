"""Adapters: the driver tables seen as statements, usage events and feeds.

All are deterministic projections of the given tables, so their size grows with
the data. Forty customers share one statement account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline import rules
from ledgerline.operators.skew import SLICE_ROWS, number_rows
from ledgerline.sources.tables import table

CUSTOMERS_PER_ACCOUNT = 40

# Sixteen description stems; the last one is blank.
PHRASES = [
    "CARD 8841 GROCERY", "ATM WITHDRAWAL", "CHECK PAID", "INTEREST EARNED",
    "DIVIDEND ACME", "MONTHLY FEE", "SURCHARGE", "ACME PAYROLL",
    "STANDING ORDER RENT", "WIRE OUT", "POS COFFEE", "CASH DEPOSIT",
    "LOAN PAYMENT", "CAFÉ MOMENTO", "REFUND & CO <LTD>", "",
]

# Per locale: headers of the export.
HEADERS = [
    ["Date", "Description", "Amount", "Balance", "Memo", "Reference"],
    ["Date", "Description", "Debit", "Credit", "Balance", "Memo", "Reference"],
    ["Posting Date", "Particulars", "Amount", "Running Bal.", "Notes", "Ref"],
    ["Transaction Date", "Details", "Value", "Type", "Balance", "Memo", "Reference"],
]
BAD_DATE_EVERY = 50
BAD_AMOUNT_EVERY = 70


def account_id(account: Column) -> Column:
    return F.lpad(account.cast("string"), 9, "0")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def cents(amount: Column) -> Column:
    """A two-decimal double as whole cents."""
    return (amount.cast("decimal(18,2)") * 100).cast("bigint")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed statement rows: one per order, numbered per account by date."""
    key = F.col("o_orderkey")
    stem = _pick(PHRASES, key % 16)
    base = table(spark, sf_dir, "orders").select(
        F.expr(f"o_custkey div {CUSTOMERS_PER_ACCOUNT}").alias("account"),
        key.alias("order_key"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", -cents(F.col("o_totalprice"))).otherwise(cents(F.col("o_totalprice"))).alias("minor"),
        F.when(stem == "", F.lit("")).otherwise(F.concat_ws(" ", stem, F.col("o_orderpriority"))).alias("description"),
    )
    rows = number_rows(base, ["account"], "date", ["order_key"], "source_row", {"balance_minor": "minor"}, SLICE_ROWS)
    key = F.col("order_key")
    return rows.withColumns(
        {
            "file_id": account_id(F.col("account")),
            "locale": (F.col("account") % 4).cast("int"),
            "memo": F.when(key % 5 == 0, F.concat(F.lit("order "), key)).when(key % 5 == 1, F.col("description")).otherwise(F.lit("")),
            "reference": F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("R"), key)),
            "seconds": (key % 86400).cast("int"),
        }
    )


def _grouped(minor: Column) -> Column:
    """1,234.56 from whole cents, sign dropped."""
    return F.format_number((F.abs(minor).cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2)


def _swap(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def _signed(minor: Column, text: Column) -> Column:
    return F.when(minor < 0, F.concat(F.lit("-"), text)).otherwise(text)


def render_cells(rows: DataFrame, corrupt: bool = False) -> DataFrame:
    """Add ``cells``: the row as the four locales write it.

    ``corrupt`` spoils the date of every 50th row and the amount of every 70th.
    """
    minor, balance = F.col("minor"), F.col("balance_minor")
    money, running = _grouped(minor), _grouped(balance)
    us_date = F.date_format("date", "M/d/yyyy")
    eu_date = F.date_format("date", "dd/MM/yyyy")
    iso_date = F.date_format(F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400 + F.col("seconds")), "yyyy-MM-dd HH:mm:ss")

    def date(text):
        return F.when(F.col("source_row") % BAD_DATE_EVERY == BAD_DATE_EVERY - 1, F.lit("NOT-A-DATE")).otherwise(text) if corrupt else text

    def amount(text):
        return F.when(F.col("source_row") % BAD_AMOUNT_EVERY == BAD_AMOUNT_EVERY - 1, F.lit("n/a")).otherwise(text) if corrupt else text

    tail = [F.col("memo"), F.col("reference")]
    us = F.array(date(us_date), F.col("description"), amount(_signed(minor, money)), _signed(balance, running), *tail)
    # A spoilt pair loses both sides: one unreadable, the other blank.
    spoilt = F.col("source_row") % BAD_AMOUNT_EVERY == BAD_AMOUNT_EVERY - 1
    credit = F.when(minor >= 0, _swap(money)).otherwise("")
    eu = F.array(
        date(eu_date),
        F.col("description"),
        amount(F.when(minor < 0, _swap(money)).otherwise("")),
        F.when(spoilt, F.lit("")).otherwise(credit) if corrupt else credit,
        _signed(balance, _swap(running)),
        *tail,
    )
    dollars = F.concat(F.lit("$"), money)
    paren = F.when(minor < 0, F.concat(F.lit("("), dollars, F.lit(")"))).otherwise(dollars)
    par = F.array(date(us_date), F.col("description"), amount(paren), _signed(balance, running), *tail)
    plain = F.translate(money, ",", "")
    iso = F.array(
        date(iso_date),
        F.col("description"),
        amount(plain),
        F.when(minor < 0, F.lit("DR")).otherwise(F.lit("CR")),
        _signed(balance, F.translate(running, ",", "")),
        *tail,
    )
    by_locale = F.when(F.col("locale") == 0, us).when(F.col("locale") == 1, eu).when(F.col("locale") == 2, par).otherwise(iso)
    return rows.withColumn("cells", by_locale)


def statement_cells(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Body rows ``(file_id, source_row, cells)`` with the typed columns kept."""
    return render_cells(statement_rows(spark, sf_dir), corrupt)


def statement_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement file: ``(file_id, account, locale, headers)``."""
    accounts = table(spark, sf_dir, "orders").select(F.expr(f"o_custkey div {CUSTOMERS_PER_ACCOUNT}").alias("account")).distinct()
    locale = (F.col("account") % 4).cast("int")
    headers = F.element_at(F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in HEADERS]), locale + 1)
    return accounts.select(account_id(F.col("account")).alias("file_id"), "account", locale.alias("locale"), headers.alias("headers"))


# --- usage events -----------------------------------------------------------

AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) AppleWebKit/605.1 Version/17.0 Safari/605.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "Mozilla/5.0 (Linux; Android 14) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1 CriOS/120.0 Mobile",
    "curl/8.4.0",
    "examplebot/1.0 (crawler)",
]
RAW_CODES = list(rules.ERROR_CODES) + ["", "TIMEOUT_EXCEEDED", "something-else", "unsupported-content"]
COUNTRIES = ["us", "GB", " de ", "usa", "", "FR"]


def props_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def session_uuid(user: Column, day: Column) -> Column:
    return F.format_string("%08x-0000-4000-8000-%012x", user, day.cast("bigint"))


def raw_usage_events(events: DataFrame) -> DataFrame:
    """Events as a beacon would send them, with wrong values mixed in.

    Works on the events table and on its stream alike.
    """
    k, user = props_k(F.col("props")), F.col("user_id")
    named = (
        F.when(F.col("event_type") == "view", "visitor_landed")
        .when((F.col("event_type") == "click") & (k < 50), "file_loaded")
        .when(F.col("event_type") == "click", "preflight_pass")
        .when(F.col("event_type") == "purchase", "conversion_success")
        .when(F.col("event_type") == "error", "conversion_failed")
        .when(F.col("event_type") == "signup", "user_logged_in")
    )
    day = F.unix_date(F.to_date("ts"))
    slugs = [layout[0] for layout in rules.BANK_LAYOUTS]
    return events.select(
        F.col("event_id"),
        F.col("ts").alias("created_at"),
        F.when(k == 99, F.lit("page_ping")).otherwise(named).alias("event"),
        F.when(k == 98, F.lit("not-a-session")).otherwise(session_uuid(user, day)).alias("session_id"),
        _pick(["dashboard", "bank", "other", "popup"], k % 4).alias("surface"),
        F.when(k % 3 == 0, _pick(slugs, user % 20)).when(k % 3 == 1, F.lit("unknown-bank")).alias("bank_slug"),
        _pick(["ofx", "qbo", "qfx", "pdf"], k % 4).alias("dialect"),
        _pick(rules.ROW_BANDS + ["9999"], k % 5).alias("row_bucket"),
        _pick(["google.com", "direct", "internal", "evil.example"], user % 4).alias("referrer_host"),
        _pick(RAW_CODES, k % len(RAW_CODES)).alias("error_code"),
        F.when(k % 11 != 10, _pick(AGENTS, k % 7)).alias("user_agent"),
        F.create_map(
            F.lit("x-vercel-ip-country"), F.when(k % 2 == 0, _pick(COUNTRIES, user % 6)),
            F.lit("cf-ipcountry"), F.when(k % 3 == 0, F.lit("IE")),
            F.lit("x-country-code"), F.lit("zz9"),
            F.lit("x-forwarded-for"), F.when(user % 10 != 0, F.concat(F.lit(" 10.0."), F.expr("user_id div 256"), F.lit("."), user % 256, F.lit(", 172.16.0.1"))),
            F.lit("x-real-ip"), F.when(user % 20 == 0, F.lit("2001:db8::1")).when(user % 20 == 10, F.lit("unknown")),
        ).alias("headers"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.operators.telemetry import clean_events

    return clean_events(raw_usage_events(table(spark, sf_dir, "events")))


def allowance_attempts(events: DataFrame) -> DataFrame:
    """Conversion attempts: purchases of a user, in milliseconds."""
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("visitor_id"), F.col("event_id").alias("attempt_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")
    )


def subscription_feed(events: DataFrame) -> DataFrame:
    """The events table as a billing change feed, ordered by event id."""
    k, user, kind = props_k(F.col("props")), F.col("user_id"), F.col("event_type")
    return events.select(
        F.col("event_id").alias("change_seq"),
        F.col("ts").alias("changed_at"),
        F.when(kind == "click", "customer.subscription.updated")
        .when(kind == "view", F.when(k % 10 == 0, "invoice.paid").otherwise("customer.subscription.updated"))
        .when(kind == "error", "customer.subscription.deleted")
        .when(kind == "signup", "customer.subscription.created")
        .otherwise("checkout.session.completed")
        .alias("type"),
        F.when(k % 7 != 0, F.format_string("user-%05d", user)).alias("user_id"),
        F.format_string("cus_%d", user).alias("customer_id"),
        F.when((kind != "purchase") | (k % 11 != 0), F.format_string("sub_%d", user)).alias("subscription_id"),
        F.when(k % 5 != 0, F.format_string("price_%d", k % 3)).alias("price_id"),
        F.when(kind.isin("click", "purchase"), "active").when(kind == "view", "trialing").when(kind == "error", "past_due").otherwise("incomplete").alias("status"),
        F.when(k % 4 != 0, F.unix_seconds(F.col("ts").cast("timestamp")) + 86400 * 30).alias("current_period_end_s"),
        (k % 2 == 0).alias("cancel_at_period_end"),
    )


# --- statement files ---------------------------------------------------------

FILE_ROWS = 2_000
FILE_DELIMITERS = [",", ";", "|", "\t"]


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows written as files: ``(file_id, file_name, length, content)``.

    A file holds at most `FILE_ROWS` rows of one account. Delimiter and encoding
    follow the locale (UTF-8 with mark, UTF-16, windows-1252, plain UTF-8), every
    third account has a preamble, and every file ends with a trailer.
    """
    cells = statement_cells(spark, sf_dir)
    delimiter = _pick(FILE_DELIMITERS, F.col("locale"))

    def quoted(c: Column) -> Column:
        risky = F.contains(c, delimiter) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n"))
        return F.when(risky, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    lines = cells.select(
        "file_id", "account", "locale", "source_row",
        F.expr(f"source_row div {FILE_ROWS}").alias("part"),
        F.array_join(F.transform("cells", quoted), "\u0001").alias("line"),
    )
    # Bounded: at most FILE_ROWS lines come together.
    files = lines.groupBy("file_id", "account", "locale", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_row", "line"))), lambda x: x["line"]).alias("lines")
    )
    headers = F.element_at(F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in HEADERS]), F.col("locale") + 1)
    head = F.array(F.array_join(headers, "\u0001"))
    preamble = F.when(F.col("account") % 3 == 0, F.array(F.lit("Account Statement"), F.concat(F.lit("Account: "), F.col("file_id")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    all_lines = F.concat(preamble, head, F.col("lines"), F.array(F.lit("End of statement"), F.lit("")))
    text = F.replace(F.array_join(all_lines, "\r\n"), F.lit("\u0001"), delimiter)
    content = (
        F.when(F.col("locale") == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(F.col("locale") == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(F.col("locale") == 2, F.encode(text, "windows-1252"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    name = F.concat_ws("-", "file_id", F.col("part").cast("string"))
    return files.select(name.alias("file_id"), F.concat(name, F.lit(".csv")).alias("file_name"), content.alias("content")).select(
        "file_id", "file_name", F.octet_length("content").cast("bigint").alias("length"), "content"
    )
