"""Data-quality checks and issue folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.catalog.common import FX, cells, corrupt_cells, headers, long, mapping, meta, profile, query, table
from ledgerline.operators import quality
from ledgerline.operators.issues import fold_issues
from ledgerline.operators.normalize import normalise, reject_issues
from ledgerline.operators.skew import SLICE_ROWS, number_rows
from ledgerline.session import staged
from ledgerline.sources.fixtures import cents


def _lines(cond: str, n: str) -> str:
    return f"array_to_string(list_transform((list(source_row ORDER BY source_row) FILTER ({cond}))[1:3], lambda r: 'line ' || (r + 2)), ', ') || CASE WHEN {n} > 3 THEN ', +' || ({n} - 3) || ' more' ELSE '' END"


def _n(cond: str) -> str:
    return f"(count(*) FILTER ({cond}))"


def _plural(n: str, one: str, many: str) -> str:
    return f"format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {many}' END"


_BADD, _BADA = "source_row % 50 = 49", "source_row % 70 = 69"
_BREAK = "locale = 3 AND source_row > 0 AND minor < 0 AND source_row % 70 <> 69"
_BLANK, _NOREF = "description = ''", "reference = ''"


def _row(check: str, when: str, status: str, detail: str) -> str:
    return f"SELECT file_id, '{check}' AS check_id, {status} AS status, {detail} AS detail FROM fx {when} GROUP BY file_id, locale"


_CHECKS = FX + f""", g AS (
  SELECT file_id, CASE WHEN {_BADD} THEN 'x' WHEN locale = 3 THEN CAST(d AS VARCHAR) || (k % 86400) ELSE CAST(d AS VARCHAR) END AS dt, lower(description) AS ds,
         CASE WHEN {_BADA} THEN NULL WHEN locale = 3 THEN abs(minor) ELSE minor END AS v, count(*) AS n FROM fx GROUP BY ALL),
dup AS (SELECT file_id, coalesce(sum(n) FILTER (n > 1), 0) AS rws, count(*) FILTER (n > 1) AS grp FROM g GROUP BY file_id),
ord AS (SELECT file_id, CASE WHEN locale = 3 THEN 'ISO' WHEN max(day(d)) FILTER (NOT {_BADD}) <= 12 THEN 'AMBIGUOUS' WHEN locale = 1 THEN 'DMY' ELSE 'MDY' END AS o FROM fx GROUP BY file_id, locale),
chk AS (
{_row('coverage', '', "'pass'", "'Checks above cover all ' || " + _plural('count(*)', 'row', 'rows') + " || ' in the file.'")} UNION ALL
{_row('mapping', '', "'pass'", "CASE locale WHEN 1 THEN 'Date, Description and a Debit/Credit pair are mapped.' ELSE 'Date, Description and Amount are all mapped.' END")} UNION ALL
{_row('date-parse', '', f"CASE WHEN {_n(_BADD)} = 0 THEN 'pass' ELSE 'warn' END", f"CASE WHEN {_n(_BADD)} = 0 THEN NULL ELSE " + _plural(_n(_BADD), 'value does', 'values do') + f" || ' not look like a date (' || {_lines(_BADD, _n(_BADD))} || ').' END")} UNION ALL
SELECT file_id, 'date-sequence', CASE WHEN o = 'AMBIGUOUS' THEN 'skip' ELSE 'pass' END, CASE WHEN o = 'AMBIGUOUS' THEN 'Day/month order is ambiguous, so ordering was not verified here.' ELSE 'Dates run in a consistent direction with no breaks.' END FROM ord UNION ALL
{_row('amount-parse', '', f"CASE WHEN {_n(_BADA)} = 0 THEN 'pass' ELSE 'warn' END", f"CASE WHEN {_n(_BADA)} = 0 THEN 'All ' || " + _plural('count(*)', 'amount reads', 'amounts read') + " || ' cleanly.' ELSE " + _plural(_n(_BADA), 'row has', 'rows have') + f" || ' an amount that is not a number (' || {_lines(_BADA, _n(_BADA))} || ').' END")} UNION ALL
{_row('debit-credit', 'WHERE locale = 1', "'pass'", "'Each row uses either the debit or the credit column, never both.'")} UNION ALL
{_row('balance-continuity', 'WHERE locale <> 2', f"CASE WHEN {_n(_BREAK)} = 0 THEN 'pass' ELSE 'warn' END", f"CASE WHEN {_n(_BREAK)} = 0 THEN 'Every running balance matches the previous balance plus the row amount.' ELSE " + _plural(_n(_BREAK), 'row does', 'rows do') + f" || ' not reconcile with the running balance (' || {_lines(_BREAK, _n(_BREAK))} || ').' END")} UNION ALL
SELECT file_id, 'duplicates', CASE WHEN grp = 0 THEN 'pass' ELSE 'warn' END, CASE WHEN grp = 0 THEN 'No two rows share a date, description and amount.' ELSE {_plural('rws', 'row repeats', 'rows repeat')} || ' another row exactly (' || {_plural('grp', 'group', 'groups')} || '). Banks do sometimes bill twice — review before removing.' END FROM dup UNION ALL
{_row('reference-unique', '', f"CASE WHEN {_n(_NOREF)} = 0 THEN 'pass' ELSE 'warn' END", f"CASE WHEN {_n(_NOREF)} = 0 THEN 'Every row carries a distinct reference id.' ELSE " + _plural(_n(_NOREF), 'row has', 'rows have') + " || ' no reference; an id will be derived from the row contents instead.' END")} UNION ALL
{_row('descriptions', '', f"CASE WHEN {_n(_BLANK)} = 0 THEN 'pass' ELSE 'warn' END", f"CASE WHEN {_n(_BLANK)} = 0 THEN 'Every row has a description to carry into the NAME field.' ELSE " + _plural(_n(_BLANK), 'row is', 'rows are') + f" || ' missing a description (' || {_lines(_BLANK, _n(_BLANK))} || '); a placeholder is used.' END")}),
fin AS (SELECT c.file_id, check_id, status, coalesce(detail, CASE o WHEN 'AMBIGUOUS' THEN 'Every value is a date, but day/month order is ambiguous — the worker settles it.' ELSE 'Every value parses as a date (' || o || ' format).' END) AS detail FROM chk c JOIN ord USING (file_id))
"""


def _totals(rows):
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_rows"))


def _fresh_checks(spark, sf):
    rows = corrupt_cells(spark, sf)
    return quality.quality_checks(rows, mapping(spark, sf), _totals(rows))


_kept: dict = {}


def _checks(spark, sf):
    """The checks written once per session; the single-check queries read them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _kept:
        _kept[key] = staged(_fresh_checks(spark, sf), "checks")
    return _kept[key]


@query("q_all_checks", _CHECKS + "SELECT * FROM fin")
def all_checks(spark, sf):
    return _fresh_checks(spark, sf).select("file_id", "check_id", "status", "detail")


def _single(name, check):
    @query(name, _CHECKS + f"SELECT file_id, status, detail FROM fin WHERE check_id = '{check}'")
    def one(spark, sf, check=check):
        return _checks(spark, sf).filter(F.col("check_id") == check).select("file_id", "status", "detail")


_single("q01_mapping", "mapping")
_single("q02_date_parse", "date-parse")
_single("q04_amount_parse", "amount-parse")
_single("q05_debit_credit", "debit-credit")
_single("q06_balance_continuity", "balance-continuity")
_single("q09_descriptions", "descriptions")


def _offenders(kind: str, cond: str) -> str:
    return f"SELECT file_id, '{kind}' AS kind, {_n(cond)} AS offenders, coalesce({_lines(cond, _n(cond))}, '') AS listing FROM fx GROUP BY file_id"


@query("q12_offender_listing", FX + " UNION ALL ".join([_offenders("bad_date", _BADD), _offenders("bad_amount", _BADA), _offenders("blank_description", _BLANK)]))
def offenders(spark, sf):
    """The listing itself, of files with many offenders, with few and with none."""
    facts = quality.row_facts(corrupt_cells(spark, sf), mapping(spark, sf))
    kinds = ("bad_date", "bad_amount", "blank_description")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("offenders"), quality.listed(F.col(f"r_{k}"), F.col(f"n_{k}")).alias("listing")) for k in kinds]))
    return facts.select("file_id", each.alias("x")).select("file_id", "x.kind", "x.offenders", "x.listing")


@query("q13_report", _CHECKS + "SELECT file_id, count(*) FILTER (status = 'fail') AS failures, count(*) FILTER (status = 'warn') AS warnings, (count(*) FILTER (status = 'fail') = 0) AS ready FROM fin GROUP BY file_id")
def report(spark, sf):
    rows = corrupt_cells(spark, sf)
    return quality.quality_report(_checks(spark, sf), _totals(rows))


def _given_mapping(files, roles):
    """The same column roles for every file."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(r).alias("role")) for i, r in enumerate(roles)])).alias("x")
    return files.select("file_id", each).select(
        "file_id", "x.col_index", F.lit("").alias("header"), "x.role", F.lit(1.0).alias("confidence"), F.lit(False).alias("user_assigned")
    )


def _by_order_key(spark, sf):
    """Orders in key order, so their dates jump back and forth."""
    rows = table(spark, sf, "orders").select(
        F.expr("o_custkey div 40").cast("string").alias("file_id"), F.expr("o_orderkey div 50000").alias("slice"), "o_orderkey",
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("cells"),
    )
    return number_rows(rows, ["file_id"], "slice", ["o_orderkey"], "source_row", whole_rows=SLICE_ROWS).select("file_id", "source_row", "cells")


@query("q03_date_sequence", f"""
WITH fx AS (SELECT CAST(o_custkey // 40 AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY o_custkey // 40 ORDER BY o_orderkey) - 1 AS source_row,
  CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey // 40 ORDER BY o_orderkey) AS p FROM orders),
s AS (SELECT *, count(*) FILTER (d > p) OVER (PARTITION BY file_id) >= count(*) FILTER (d < p) OVER (PARTITION BY file_id) AS up FROM fx),
b AS (SELECT *, CASE WHEN up THEN d < p ELSE d > p END AS bad FROM s)
SELECT file_id, CASE WHEN {_n('bad')} = 0 THEN 'pass' ELSE 'warn' END AS status,
       {_plural(_n('bad'), 'row breaks', 'rows break')} || ' the date order (' || {_lines('bad', _n('bad'))} || ').' AS detail FROM b GROUP BY file_id""")
def date_sequence(spark, sf):
    rows = _by_order_key(spark, sf)
    checks = quality.quality_checks(rows, _given_mapping(rows.select("file_id").distinct(), ["date", "description", "amount"]), _totals(rows))
    return checks.filter(F.col("check_id") == "date-sequence").select("file_id", "status", "detail")


def _fee_cells(spark, sf):
    """Line items per supplier: repeated rows and repeated references."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file_id"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.array(
            F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd"), F.col("l_linestatus"),
            F.concat(F.lit("0."), F.lpad(cents(F.col("l_tax")).cast("string"), 2, "0")), F.col("l_orderkey").cast("string"),
        ).alias("cells"),
    )
    numbered = number_rows(rows, ["file_id"], "day", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "source_row", whole_rows=SLICE_ROWS)
    return numbered.select("file_id", "source_row", "cells")


def _fee_checks(spark, sf, check, sample_rows=None):
    rows = staged(_fee_cells(spark, sf), "fees")
    given = _given_mapping(rows.select("file_id").distinct(), ["date", "description", "amount", "referenceNumber"])
    checks = quality.quality_checks(rows, given, _totals(rows), sample_rows)
    return checks.filter(F.col("check_id") == check).select("file_id", "status", "detail")


@query("q07_duplicates", f"""
WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, date_trunc('month', l_shipdate) AS m, l_linestatus AS s, CAST(l_tax AS DECIMAL(18,2)) AS t, count(*) AS n FROM lineitem GROUP BY ALL),
dup AS (SELECT file_id, coalesce(sum(n) FILTER (n > 1), 0) AS rws, count(*) FILTER (n > 1) AS grp FROM g GROUP BY file_id)
SELECT file_id, CASE WHEN grp = 0 THEN 'pass' ELSE 'warn' END AS status, CASE WHEN grp = 0 THEN 'No two rows share a date, description and amount.' ELSE
  {_plural('rws', 'row repeats', 'rows repeat')} || ' another row exactly (' || {_plural('grp', 'group', 'groups')} || '). Banks do sometimes bill twice — review before removing.' END AS detail FROM dup""")
def duplicates(spark, sf):
    return _fee_checks(spark, sf, "duplicates")


@query("q08_references", f"""
WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey)
SELECT file_id, CASE WHEN n = 0 THEN 'pass' ELSE 'warn' END AS status, CASE WHEN n = 0 THEN 'Every row carries a distinct reference id.' ELSE
  {_plural('n', 'reference is', 'references are')} || ' reused. Duplicate IDs collide when the transaction id is derived.' END AS detail FROM r""")
def references(spark, sf):
    return _fee_checks(spark, sf, "reference-unique")


@query("q10_empty", FX + """
SELECT file_id, 'fail' AS status, 'The file has a header but no transaction rows underneath it.' AS detail FROM fx WHERE account % 4 = 1 GROUP BY file_id""")
def empty(spark, sf):
    rows = cells(spark, sf).filter(F.col("account") % 4 != 1)
    totals = headers(spark, sf).select("file_id").join(_totals(rows), "file_id", "left").na.fill(0, ["total_rows"])
    checks = quality.quality_checks(rows, mapping(spark, sf), totals)
    return checks.filter(F.col("check_id") == "empty").select("file_id", "status", "detail")


@query("q11_coverage", FX + f"""
SELECT file_id, CASE WHEN count(*) > 20 THEN 'skip' ELSE 'pass' END AS status, CASE WHEN count(*) > 20 THEN
  'Checks above cover the first 20 of ' || format('{{:,}}', count(*)) || ' rows. The remainder is verified during conversion.'
  ELSE 'Checks above cover all ' || {_plural('count(*)', 'row', 'rows')} || ' in the file.' END AS detail FROM fx GROUP BY file_id""")
def coverage(spark, sf):
    rows = cells(spark, sf)
    checks = quality.quality_checks(rows, mapping(spark, sf), _totals(rows), sample_rows=20)
    return checks.filter(F.col("check_id") == "coverage").select("file_id", "status", "detail")


@query("a05_issue_fold", FX + f""", iss AS (
  SELECT file_id, source_row, CASE WHEN {_BADD} THEN 'bad-date' ELSE 'bad-amount' END AS code FROM fx WHERE {_BADD} OR {_BADA}),
f AS (SELECT file_id, code, count(*) AS n, CASE code WHEN 'bad-date' THEN 'Row skipped: unreadable date' ELSE 'Row skipped: no amount' END AS l,
             CASE code WHEN 'bad-date' THEN 'Skipped row: "NOT-A-DATE" is not a date.' ELSE 'Skipped row: no parseable amount.' END AS m FROM iss GROUP BY ALL)
SELECT file_id, 'worker-' || code || '-grouped' AS check_id, CASE WHEN n > 1 THEN l || ' (' || n || ' rows)' ELSE l END AS label, 'warn' AS status,
       CASE WHEN n > 1 THEN n || ' rows were skipped for this reason. First: ' || m ELSE m END AS detail FROM f UNION ALL
SELECT file_id, 'worker-some-new_code-0', 'Some new code', 'fail', 'x' FROM fx GROUP BY file_id""")
def folded(spark, sf):
    found = reject_issues(normalise(corrupt_cells(spark, sf), profile(spark, sf), meta(spark, sf))).withColumn("ordinal", F.lit(9))
    extra = headers(spark, sf).select(
        "file_id", F.lit("error").alias("level"), F.lit("some-new_code").alias("code"), F.lit("x").alias("message"),
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("int").alias("column"), F.lit(0).alias("ordinal"),
    )
    return fold_issues(found.unionByName(extra)).select("file_id", "check_id", "label", "status", "detail")
