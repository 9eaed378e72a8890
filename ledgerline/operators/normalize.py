"""Statement rows to canonical transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.classify import indicates_debit, transaction_type
from ledgerline.functions.dates import date_parts
from ledgerline.functions.money import MINOR, minor_units
from ledgerline.functions.staged import Parser, parse, pin
from ledgerline.operators.columns import role_cell
from ledgerline.functions.text import account_key
from ledgerline.operators.formats import currency_conflicts

ISSUE = ["file_id", "level", "code", "message", "row", "column"]
TRANSACTION = [
    "file_id", "account_id", "source_row", "date_posted", "time_seconds", "date_user", "type", "amount_minor",
    "currency", "scale", "name", "memo", "check_number", "reference_number", "balance_minor",
]
PROFILE = ["file_id", "at", "convention", "date_order", "date_has_time", "decimal_separator", "group_separator"]


def account_meta(files: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """One account row per file, defaults where nothing was supplied.

    ``accounts`` may carry any of the account columns, keyed by ``file_id``. A
    blank or missing account id is the file's base name, never its folder, so
    identifiers outlive a move of the file.
    """
    supplied = set(accounts.columns) - {"file_id"} if accounts is not None else set()
    name = F.col("file_name") if "file_name" in files.columns else F.element_at(F.split("file_id", "/"), -1)
    out = files.select("file_id", name.alias("__name"))
    if accounts is not None:
        out = out.join(accounts, "file_id", "left")
    given = F.col("account_id") if "account_id" in supplied else F.lit(None).cast("string")
    out = out.withColumn("account_id", account_key(given, F.col("__name"))).drop("__name")
    for name, default in rules.ACCOUNT_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in supplied else F.lit(default))
    return out


def attach_profile(rows: DataFrame, profile: DataFrame, accounts: DataFrame) -> DataFrame:
    """Put each file's profile and account beside its rows.

    There may be millions of files, so nothing is forced to broadcast: Spark
    does that itself while it measures the profiles small, and otherwise splits
    a hot file's partition at run time. An outer join keeps the rows the
    streamed side.
    """
    side = profile.select(*PROFILE).join(
        accounts.select("file_id", "account_id", "scale", F.col("currency").alias("account_currency")), "file_id"
    )
    return rows.join(side, "file_id", "left")


def signed_amount() -> Column:
    """One signed value under the file's convention; NULL when unreadable.

    ``first_minor`` is the debit of a pair and otherwise the amount,
    ``second_minor`` the credit of a pair.
    """
    first, second = F.col("first_minor"), F.col("second_minor")
    pair = (
        F.when(first.isNotNull() & (first != 0), -F.abs(first))
        .when(second.isNotNull() & (second != 0), F.abs(second))
        .when(first.isNull() & second.isNull(), F.lit(None))
        .otherwise(F.lit(0))
    )
    marked = F.when(indicates_debit(F.col("type_cell")), -F.abs(first)).otherwise(F.abs(first))
    convention = F.col("convention")
    return (
        F.when(convention == "debit-credit", pair)
        .when(convention == "magnitude-with-indicator", marked)
        .when(convention == "signed-inverted", -first)
        .otherwise(first)
        .cast(MINOR)
    )


def normalise(rows: DataFrame, profile: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every body row as a transaction, with ``reject_code`` where it is none.

    One projection and one join; split the result with `accepted` and
    `reject_issues`.
    """
    df = attach_profile(rows.select("file_id", "source_row", "cells"), profile, accounts)
    posted = role_cell("postedDate")
    pair = F.col("convention") == "debit-credit"
    # Cells first, so the wide array does not travel through the parsers.
    df = df.select(
        "file_id",
        "account_id",
        "source_row",
        "scale",
        "account_currency",
        "convention",
        "date_order",
        "date_has_time",
        "decimal_separator",
        "group_separator",
        F.coalesce(F.nullif(role_cell("date"), F.lit("")), posted).alias("date_cell"),
        F.when(F.col("at.date").isNotNull(), posted).otherwise(F.lit("")).alias("user_cell"),
        F.when(pair, role_cell("debit")).otherwise(role_cell("amount")).alias("first_cell"),
        F.when(pair, role_cell("credit")).otherwise(F.lit("")).alias("second_cell"),
        role_cell("balance").alias("balance_cell"),
        role_cell("type").alias("type_cell"),
        F.coalesce(F.nullif(role_cell("description"), F.lit("")), role_cell("payee")).alias("description"),
        role_cell("memo").alias("memo_cell"),
        role_cell("currency").alias("currency_cell"),
        role_cell("checkNumber").alias("check_cell"),
        role_cell("referenceNumber").alias("reference_cell"),
    )

    def minor(cell: str) -> Parser:
        return minor_units(F.col(cell), F.col("decimal_separator"), F.col("group_separator"), F.col("scale"))

    order = F.col("date_order")
    df = parse(
        df,
        {
            "posted": date_parts(F.col("date_cell"), order),
            "user": date_parts(F.col("user_cell"), order),
            "first_minor": minor("first_cell"),
            "second_minor": minor("second_cell"),
            "balance_minor": minor("balance_cell"),
        },
    )
    text = F.concat_ws(" ", "type_cell", "description")
    resolved = pin(df, {"amount_minor": signed_amount(), "text": text, "lowered": F.lower(text)})
    description, memo = F.col("description"), F.col("memo_cell")
    return resolved.select(
        "file_id",
        "account_id",
        "source_row",
        F.col("posted_date").alias("date_posted"),
        F.when(F.col("date_has_time"), F.col("posted_time_seconds")).alias("time_seconds"),
        F.col("user_date").alias("date_user"),
        transaction_type(F.col("text"), F.col("lowered"), F.col("amount_minor")).alias("type"),
        "amount_minor",
        F.coalesce(F.nullif(F.upper("currency_cell"), F.lit("")), F.col("account_currency")).alias("currency"),
        "scale",
        F.coalesce(F.nullif(description, F.lit("")), F.nullif(memo, F.lit("")), F.lit(rules.NAME_PLACEHOLDER)).alias("name"),
        F.when((memo != "") & (memo != description), memo).alias("memo"),
        F.nullif("check_cell", F.lit("")).alias("check_number"),
        F.nullif("reference_cell", F.lit("")).alias("reference_number"),
        "balance_minor",
        F.when(F.col("posted_date").isNull(), "bad-date").when(F.col("amount_minor").isNull(), "bad-amount").alias("reject_code"),
        "date_cell",
    )


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject_code").isNull()).select(*TRANSACTION)


def reject_issues(normalised: DataFrame) -> DataFrame:
    """One warning per skipped row."""
    bad_date = F.concat(F.lit('Skipped row: "'), F.col("date_cell"), F.lit('" is not a date.'))
    return normalised.filter(F.col("reject_code").isNotNull()).select(
        "file_id",
        F.lit("warning").alias("level"),
        F.col("reject_code").alias("code"),
        F.when(F.col("reject_code") == "bad-date", bad_date).otherwise("Skipped row: no parseable amount.").alias("message"),
        F.col("source_row").alias("row"),
        F.lit(None).cast("int").alias("column"),
    )


def currency_issues(transactions: DataFrame) -> DataFrame:
    """Files that mix currencies anywhere, not only in the sampled rows."""
    message = F.concat(
        F.lit("The file mixes "), F.array_join("currencies", ", "), F.lit(". A single OFX statement can only declare one currency.")
    )
    return (
        currency_conflicts(transactions, ["file_id"], "currency")
        .filter("conflict")
        .select(
            "file_id",
            F.lit("error").alias("level"),
            F.lit("multi-currency").alias("code"),
            message.alias("message"),
            F.lit(None).cast("bigint").alias("row"),
            F.lit(None).cast("int").alias("column"),
        )
    )


def file_outcomes(files: DataFrame, counts: DataFrame, issues: DataFrame) -> DataFrame:
    """Converted or failed, per file.

    ``counts`` is ``(file_id, accepted_rows)``; any error fails the file, and so
    do zero accepted rows. The code is that of the first error in reporting order
    (``ordinal``, where the issues have one).
    """
    order = F.col("ordinal") if "ordinal" in issues.columns else F.lit(0)
    error = F.col("level") == "error"
    levels = issues.groupBy("file_id").agg(
        F.count_if(error).alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.min(F.when(error, F.struct(order.alias("at"), F.col("code")))).getField("code").alias("error_code"),
    )
    joined = files.select("file_id").join(counts, "file_id", "left").join(levels, "file_id", "left")
    rows = F.coalesce("accepted_rows", F.lit(0))
    errors = F.coalesce("errors", F.lit(0))
    return joined.select(
        "file_id",
        F.when((errors == 0) & (rows > 0), "converted").otherwise("failed").alias("outcome"),
        rows.cast("bigint").alias("transaction_count"),
        F.coalesce("warnings", F.lit(0)).cast("bigint").alias("warnings"),
        F.when(errors > 0, F.col("error_code")).when(rows == 0, F.lit("no-transactions")).alias("failure_code"),
    )


def empty_file_issues(outcomes: DataFrame) -> DataFrame:
    """The finding of every file that failed for want of transactions alone."""
    return outcomes.filter(F.col("failure_code") == "no-transactions").select(
        "file_id",
        F.lit("error").alias("level"),
        F.lit("no-transactions").alias("code"),
        F.lit(rules.NO_TRANSACTIONS).alias("message"),
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast("int").alias("column"),
    )
