"""Shared pieces of the registered queries and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.columns import map_columns
from ledgerline.operators.formats import profile_formats
from ledgerline.operators.normalize import accepted, account_meta, normalise
from ledgerline.session import configure, staged
from ledgerline.sources import fixtures
from ledgerline.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@lru_cache(maxsize=None)
def _staged_once(app: str, spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    maker = {
        "cells": lambda: fixtures.statement_cells(spark, sf_dir),
        "corrupt": lambda: fixtures.statement_cells(spark, sf_dir, corrupt=True),
        "events": lambda: fixtures.usage_events(spark, sf_dir),
        "files": lambda: fixtures.statement_files(spark, sf_dir),
        "mapping": lambda: map_columns(headers(spark, sf_dir), cells(spark, sf_dir)),
        "profile": lambda: profile_formats(cells(spark, sf_dir), mapping(spark, sf_dir)),
        "normalised": lambda: normalise(cells(spark, sf_dir), profile(spark, sf_dir), meta(spark, sf_dir)),
    }[what]
    made = staged(maker(), what)
    # Asked of the written files: asking the plan itself would run its shuffles once more.
    even = spread(made)
    return made if even is made else staged(even, what)


def _once(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """A fixture or intermediate written to the work folder once per session."""
    return _staged_once(spark.sparkContext.applicationId, spark, sf_dir, what)


def cells(spark, sf_dir):
    return _once(spark, sf_dir, "cells")


def corrupt_cells(spark, sf_dir):
    return _once(spark, sf_dir, "corrupt")


def events(spark, sf_dir):
    return _once(spark, sf_dir, "events")


def files(spark, sf_dir):
    return _once(spark, sf_dir, "files")


def headers(spark, sf_dir):
    return fixtures.statement_headers(spark, sf_dir)


def mapping(spark, sf_dir):
    return _once(spark, sf_dir, "mapping")


def profile(spark, sf_dir):
    return _once(spark, sf_dir, "profile")


def meta(spark, sf_dir):
    return account_meta(headers(spark, sf_dir))


def normalised(spark, sf_dir):
    return _once(spark, sf_dir, "normalised")


def transactions(spark, sf_dir):
    return accepted(normalised(spark, sf_dir))


def as_of(events_df: DataFrame):
    """The newest event time: one row, answered from the file footers."""
    return events_df.agg(F.max("created_at")).first()[0]


def micros(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


def long(name):
    return F.col(name).cast("bigint").alias(name)


__all__ = [n for n in dir() if not n.startswith("_")]

# --- the statement fixture as SQL, from the typed columns ----------------------

_STEMS = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(fixtures.PHRASES))
_TYPES = {1: "ATM", 2: "CHECK", 3: "INT", 4: "DIV", 5: "SRVCHG", 6: "FEE", 7: "DIRECTDEP", 8: "DIRECTDEBIT", 9: "XFER", 10: "POS", 11: "DEP", 12: "PAYMENT"}
_KINDS = " ".join(f"WHEN {i} THEN '{t}'" for i, t in _TYPES.items())

FX = f"""
WITH base AS (
  SELECT o_custkey // 40 AS account, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS minor,
         CASE WHEN o_orderkey % 16 = 15 THEN '' ELSE (CASE o_orderkey % 16 {_STEMS} END) || ' ' || o_orderpriority END AS description
  FROM orders),
fx AS (
  SELECT *, lpad(CAST(account AS VARCHAR), 9, '0') AS file_id, account % 4 AS locale,
         row_number() OVER (PARTITION BY account ORDER BY d, k) - 1 AS source_row,
         CAST(sum(minor) OVER (PARTITION BY account ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_minor,
         CASE WHEN k % 5 = 0 THEN 'order ' || k WHEN k % 5 = 1 THEN description ELSE '' END AS memo_cell,
         CASE WHEN k % 11 = 0 THEN '' ELSE 'R' || k END AS reference
  FROM base),
tx AS (
  SELECT *, CASE WHEN description <> '' THEN description WHEN memo_cell <> '' THEN memo_cell ELSE 'TRANSACTION' END AS name,
         CASE WHEN memo_cell <> '' AND memo_cell <> description THEN memo_cell END AS memo,
         CASE k % 16 {_KINDS} ELSE CASE WHEN minor < 0 THEN 'DEBIT' ELSE 'CREDIT' END END AS type,
         CASE WHEN minor < 0 THEN '-' ELSE '' END || (abs(minor) // 100) || '.' || lpad(CAST(abs(minor) % 100 AS VARCHAR), 2, '0') AS amount_text
  FROM fx),
ids AS (
  SELECT *, upper(substr(sha1(file_id || '|' || strftime(d, '%Y%m%d') || '|' || amount_text || '|' || upper(trim(coalesce(memo, name)))), 1, 32)) AS base_id
  FROM tx),
fit AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, base_id ORDER BY source_row) AS nth FROM ids),
ident AS (
  SELECT *, CASE WHEN nth = 1 THEN base_id ELSE base_id || '-' || nth END AS fit_id FROM fit)
"""

# The cells of every row as the locales write them.
CELLS = FX + """, money AS (
  SELECT *, format('{:,}', abs(minor) // 100) || '.' || lpad(CAST(abs(minor) % 100 AS VARCHAR), 2, '0') AS m,
         format('{:,}', abs(balance_minor) // 100) || '.' || lpad(CAST(abs(balance_minor) % 100 AS VARCHAR), 2, '0') AS r,
         CASE WHEN minor < 0 THEN '-' ELSE '' END AS ms, CASE WHEN balance_minor < 0 THEN '-' ELSE '' END AS rs FROM fx),
drawn AS (
  SELECT *, CASE locale
    WHEN 0 THEN [strftime(d, '%-m/%-d/%Y'), description, ms || m, rs || r, memo_cell, reference]
    WHEN 1 THEN [strftime(d, '%d/%m/%Y'), description, CASE WHEN minor < 0 THEN translate(m, ',.', '.,') ELSE '' END,
                 CASE WHEN minor < 0 THEN '' ELSE translate(m, ',.', '.,') END, rs || translate(r, ',.', '.,'), memo_cell, reference]
    WHEN 2 THEN [strftime(d, '%-m/%-d/%Y'), description, CASE WHEN minor < 0 THEN '($' || m || ')' ELSE '$' || m END, rs || r, memo_cell, reference]
    ELSE [strftime(d + to_seconds(k % 86400), '%Y-%m-%d %H:%M:%S'), description, replace(m, ',', ''), CASE WHEN minor < 0 THEN 'DR' ELSE 'CR' END, rs || replace(r, ',', ''), memo_cell, reference]
  END AS cells FROM money)
"""
