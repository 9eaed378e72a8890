"""From files to statements: the jobs put together.

Rows that several later steps need are written once to the shared work folder
and read back, so no file is decoded twice and a lost executor costs only its
own tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline import rules
from ledgerline.operators import layout as lay
from ledgerline.operators.columns import apply_overrides, apply_preset, layout_headers, map_columns
from ledgerline.operators.formats import money_files, profile_formats, sample_collisions
from ledgerline.operators.identity import source_digest, with_fit_ids
from ledgerline.operators.normalize import accepted, account_meta, currency_issues, empty_file_issues, file_outcomes, normalise, reject_issues
from ledgerline.operators.statements import documents, statements
from ledgerline.session import staged
from ledgerline.sources.landing import decode_files, scan_files, triage
from ledgerline.sources.large import large_layout


class Inspection(NamedTuple):
    files: DataFrame
    rows: DataFrame
    mapping: DataFrame
    profile: DataFrame
    issues: DataFrame


class Conversion(NamedTuple):
    transactions: DataFrame
    statements: DataFrame
    issues: DataFrame
    outcomes: DataFrame


def inspect_files(
    files: DataFrame, declared_charset: str | None = None, presets: DataFrame | None = None, overrides: DataFrame | None = None, conventions: DataFrame | None = None
) -> Inspection:
    """Profile every file of a landing zone.

    The files of the result carry their ``source_digest``, from the length as scanned, the headers and the rows.
    ``presets`` ``(file_id, bank_slug)`` lays declared bank layouts over the
    inferred roles, ``overrides`` ``(file_id, col_index, role)`` sets roles by
    hand; formats and sign convention are then derived from the resulting roles.
    ``conventions`` ``(file_id, convention)`` replaces the derived one, which is
    the only way to ``signed-inverted``.
    """
    return _inspect(*_lay_out(files, declared_charset), presets, overrides, conventions)


def inspect_folder(
    spark: SparkSession, path: str, declared_charset: str | None = None, presets: DataFrame | None = None, overrides: DataFrame | None = None, conventions: DataFrame | None = None,
    whole_bytes: int = rules.MAX_INPUT_BYTES,
) -> Inspection:
    """Profile every file below a path, whatever its size: up to ``whole_bytes`` as one row, beyond it in splits.

    Declared charsets are a column of the file listing and hold for whole files;
    the large ones go by their byte order mark and bytes.
    """
    whole = _lay_out(scan_files(spark, path, whole_bytes).filter(F.col("length") <= whole_bytes), declared_charset)
    if scan_files(spark, path, whole_bytes).filter(F.col("length") > whole_bytes).select("file_id").isEmpty():
        return _inspect(*whole, presets, overrides, conventions)
    large = large_layout(spark, path, over=whole_bytes)
    columns = ["file_id", "file_name", "length", "kind", "format", "reject_code", "reject_message"]
    judged = whole[0].select(*columns).unionByName(large.judged.select(*columns))
    heads = staged(whole[1].unionByName(large.heads.select(*whole[1].columns)), "heads")
    rows = staged(whole[2].unionByName(large.rows), "rows")
    return _inspect(judged, heads, rows, presets, overrides, conventions)


def _lay_out(files: DataFrame, declared_charset: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triage, layout and body rows of whole files."""
    judged = triage(files)
    layout = staged(lay.lay_out(decode_files(judged.filter(F.col("kind") == "text"), declared_charset)), "layout")
    return judged, layout.drop("body"), staged(lay.body_rows(layout), "rows")


def _inspect(judged: DataFrame, heads: DataFrame, rows: DataFrame, presets: DataFrame | None, overrides: DataFrame | None, conventions: DataFrame | None) -> Inspection:
    mapping = map_columns(heads.filter(F.col("row_count") > 0).select("file_id", "headers"), rows)
    if presets is not None:
        mapping = apply_preset(mapping, presets, layout_headers(judged.sparkSession))
    if overrides is not None:
        mapping = apply_overrides(mapping, overrides)
    mapping = staged(mapping, "mapping")
    profile = profile_formats(rows, mapping)
    if conventions is not None:
        chosen = conventions.select("file_id", F.col("convention").alias("__chosen"))
        profile = profile.join(chosen, "file_id", "left").withColumn("convention", F.coalesce("__chosen", "convention")).drop("__chosen")
    profile = staged(profile, "profile")
    refused = judged.filter(F.col("reject_code").isNotNull()).select(
        "file_id",
        F.lit(0).alias("ordinal"),
        F.lit("error").alias("level"),
        F.col("reject_code").alias("code"),
        F.col("reject_message").alias("message"),
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast("int").alias("column"),
    )
    collisions = sample_collisions(rows, profile, profile).withColumn("ordinal", F.lit(8))
    issues = staged(
        refused.unionByName(lay.layout_issues(heads))
        .unionByName(lay.column_issues(profile, money_files(rows, profile)))
        .unionByName(collisions),
        "issues",
    )
    listing = judged.select("file_id", "file_name", "length", "kind", "format").join(
        heads.drop("file_name", "length", "kind", "format", "reject_code", "reject_message"), "file_id", "left"
    )
    listing = listing.withColumn("source_digest", F.when(F.col("row_count").isNotNull(), source_digest(F.col("length"), F.col("headers"), F.col("row_count"))))
    return Inspection(listing, rows, mapping, profile, issues)


def convert_rows(files: DataFrame, rows: DataFrame, profile: DataFrame, issues: DataFrame | None = None, accounts: DataFrame | None = None) -> Conversion:
    """Convert body rows under their profiles.

    Files with an error keep their outcome but give no statement.
    """
    meta = account_meta(files, accounts)
    fatal = issues.filter(F.col("level") == "error").select("file_id").distinct() if issues is not None else None
    wanted = rows.join(fatal, "file_id", "left_anti") if fatal is not None else rows
    normalised = staged(normalise(wanted, profile, meta), "normalised")
    good = accepted(normalised)
    found = reject_issues(normalised).unionByName(currency_issues(good)).withColumn("ordinal", F.lit(9))
    everything = found if issues is None else issues.unionByName(found)
    counts = good.groupBy("file_id").agg(F.count(F.lit(1)).alias("accepted_rows"))
    outcomes = staged(file_outcomes(files, counts, everything), "outcomes")
    everything = everything.unionByName(empty_file_issues(outcomes).withColumn("ordinal", F.lit(10)))
    usable = outcomes.filter(F.col("outcome") == "converted").select("file_id")
    transactions = with_fit_ids(good.join(usable, "file_id", "left_semi"))
    return Conversion(transactions, statements(transactions, meta.join(usable, "file_id", "left_semi")), everything, outcomes)


def convert_files(
    files: DataFrame,
    accounts: DataFrame | None = None,
    declared_charset: str | None = None,
    presets: DataFrame | None = None,
    overrides: DataFrame | None = None,
    conventions: DataFrame | None = None,
) -> tuple[Inspection, Conversion]:
    inspection = inspect_files(files, declared_charset, presets, overrides, conventions)
    return inspection, convert_rows(inspection.files, inspection.rows, inspection.profile, inspection.issues, accounts)


def convert_folder(
    spark: SparkSession, path: str, accounts: DataFrame | None = None, declared_charset: str | None = None, presets: DataFrame | None = None, overrides: DataFrame | None = None,
    conventions: DataFrame | None = None, whole_bytes: int = rules.MAX_INPUT_BYTES,
) -> tuple[Inspection, Conversion]:
    """`convert_files` for everything below a path, files of any size among it."""
    inspection = inspect_folder(spark, path, declared_charset, presets, overrides, conventions, whole_bytes)
    return inspection, convert_rows(inspection.files, inspection.rows, inspection.profile, inspection.issues, accounts)


def to_documents(conversion: Conversion, dialect: str = "ofx") -> DataFrame:
    return documents(conversion.transactions, conversion.statements, dialect)
