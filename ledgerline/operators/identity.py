"""Stable transaction ids, statement ids and source digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.dates import render_date
from ledgerline.functions.money import render_minor
from ledgerline.functions.text import strip
from ledgerline.operators.skew import occurrence_number

UNIT = "\u001f"


def _digest32(material: Column) -> Column:
    return F.upper(F.substring(F.sha1(material), 1, 32))


def fingerprint(account: Column, date: Column, amount_text: Column, text: Column) -> Column:
    """Account, day, decimal amount and trimmed upper text, hashed to 32 hex."""
    return _digest32(F.concat_ws("|", account, render_date(date), amount_text, F.upper(strip(text))))


def with_fit_ids(transactions: DataFrame, supplied: str | None = None) -> DataFrame:
    """Add ``fit_id``: the fingerprint, with ``-n`` on its nth occurrence.

    The count runs in row order inside one file, so rows appended later never
    renumber earlier ones. A non-blank ``supplied`` column is kept as the base.
    """
    text = F.coalesce(F.nullif(F.col("memo"), F.lit("")), F.col("name"))
    derived = fingerprint(F.col("account_id"), F.col("date_posted"), render_minor(F.col("amount_minor"), F.col("scale")), text)
    base = F.coalesce(F.nullif(F.col(supplied), F.lit("")), derived) if supplied else derived
    numbered = occurrence_number(transactions.withColumn("__base", base), ["file_id", "__base"], "source_row", "__nth")
    fit_id = F.when(F.col("__nth") == 1, F.col("__base")).otherwise(F.concat_ws("-", F.col("__base"), F.col("__nth")))
    return numbered.withColumn("fit_id", fit_id).drop("__base", "__nth")


def statement_uid(bank: Column, account: Column, count: Column, first_id: Column, last_id: Column) -> Column:
    material = F.concat_ws(UNIT, bank, account, count.cast("string"), first_id, last_id)
    return F.when(count > 0, _digest32(material)).otherwise("NONE")


def source_digest(length: Column, headers: Column, rows: Column) -> Column:
    return F.sha1(F.concat_ws(":", length.cast("string"), F.array_join(headers, UNIT), rows.cast("string")))
