"""Row operators: cells to transactions, identity, statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.catalog.common import CELLS, FX, cells, corrupt_cells, files, headers, long, mapping, meta, normalised, profile, query, transactions
from ledgerline.functions import classify, dates, money, text
from ledgerline.functions.staged import parse
from ledgerline.operators import identity, normalize, skew, statements
from ledgerline.operators.columns import cell, date_index, role_cell, roles_by_file
from ledgerline.operators.formats import currency_conflicts, date_samples
from ledgerline.plans.convert import convert_rows, inspect_files, to_documents
from ledgerline.sources.fixtures import cents
from ledgerline.sources.tables import spread, table

_CONV = "CASE locale WHEN 1 THEN 'debit-credit' WHEN 3 THEN 'magnitude-with-indicator' ELSE 'signed' END"


@query("n01_attach_profile", FX + f"""
SELECT file_id, account_id, convention, date_order, decimal_separator, account_currency, count(*) AS n FROM (
  SELECT file_id, file_id AS account_id, {_CONV} AS convention, CASE locale WHEN 1 THEN 'DMY' WHEN 3 THEN 'YMD' ELSE 'MDY' END AS date_order,
         CASE locale WHEN 1 THEN ',' ELSE '.' END AS decimal_separator, 'USD' AS account_currency FROM fx) t
GROUP BY ALL""")
def attach(spark, sf):
    joined = normalize.attach_profile(cells(spark, sf), profile(spark, sf), meta(spark, sf))
    return joined.groupBy("file_id", "account_id", "convention", "date_order", "decimal_separator", "account_currency").agg(F.count(F.lit(1)).alias("n"))


@query("n02_cells_by_role", FX + "SELECT file_id, source_row, description, memo_cell AS memo, reference, '' AS payee FROM fx")
def by_role(spark, sf):
    joined = cells(spark, sf).select("file_id", "source_row", "cells").join(profile(spark, sf).select("file_id", "at"), "file_id")
    return joined.select(
        "file_id", "source_row", role_cell("description").alias("description"), role_cell("memo").alias("memo"),
        role_cell("referenceNumber").alias("reference"), role_cell("payee").alias("payee"),
    )


def _dated(spark, sf):
    joined = cells(spark, sf).select("file_id", "source_row", "cells").join(profile(spark, sf).select("file_id", "at", "date_order", "date_has_time"), "file_id")
    return joined.select("file_id", "source_row", "date_order", "date_has_time", cell(date_index()).alias("value"))


@query("n03_date_tokens", FX + """
SELECT file_id, source_row, CAST(CASE locale WHEN 1 THEN day(d) WHEN 3 THEN year(d) ELSE month(d) END AS BIGINT) AS a,
       CAST(CASE locale WHEN 0 THEN day(d) WHEN 2 THEN day(d) ELSE month(d) END AS BIGINT) AS b,
       CAST(CASE locale WHEN 3 THEN day(d) ELSE year(d) END AS BIGINT) AS c,
       CASE locale WHEN 3 THEN '-' ELSE '/' END AS separator, CAST(CASE locale WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS year_at
FROM fx""")
def tokens(spark, sf):
    parts = dates.with_date_parts(_dated(spark, sf), "value", "p")
    return parts.select("file_id", "source_row", *[F.col(f"p_{x}").cast("bigint").alias(x) for x in ("a", "b", "c", "year_at")], F.col("p_separator").alias("separator"))


@query("n04_dates", FX + "SELECT file_id, source_row, d AS date_posted FROM fx")
def parsed_dates(spark, sf):
    parts = parse(_dated(spark, sf), {"p": dates.date_parts(F.col("value"), F.col("date_order"))})
    return parts.select("file_id", "source_row", F.col("p_date").alias("date_posted"))


@query("n05_time_of_day", FX + "SELECT file_id, source_row, CASE WHEN locale = 3 THEN k % 86400 END AS time_seconds FROM fx")
def times(spark, sf):
    parts = parse(_dated(spark, sf), {"p": dates.date_parts(F.col("value"), F.col("date_order"))})
    return parts.select("file_id", "source_row", F.when(F.col("date_has_time"), F.col("p_time_seconds")).cast("bigint").alias("time_seconds"))


@query("n06_preview_ordinal", FX + """
SELECT file_id, source_row, CAST(d - DATE '1970-01-01' AS BIGINT) AS ordinal FROM fx""")
def ordinals(spark, sf):
    parts = dates.with_preview_parts(_dated(spark, sf), "value", "p")
    order = F.when(F.col("date_order") == "YMD", "ISO").otherwise(F.col("date_order"))
    return parts.select("file_id", "source_row", dates.preview_ordinal("p", order).cast("bigint").alias("ordinal"))


def _styled(spark, sf):
    """Order totals in ten ways of writing money, US separators."""
    minor = cents(F.col("o_totalprice"))
    style = F.col("o_orderkey") % 10
    grouped = F.format_number((minor.cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2)
    plain = F.translate(grouped, ",", "")
    written = (
        F.when(style == 0, plain).when(style == 1, F.concat(F.lit("-"), grouped)).when(style == 2, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(style == 3, F.concat(plain, F.lit("-"))).when(style == 4, F.concat(plain, F.lit(" DR"))).when(style == 5, F.concat(F.lit(" $"), grouped, F.lit(" ")))
        .when(style == 6, F.concat(F.lit("USD "), grouped)).when(style == 7, F.concat(F.lit("(-"), plain, F.lit(")"))).when(style == 8, F.concat(F.lit("+ "), grouped, F.lit(" CR")))
        .otherwise(F.concat(grouped, F.lit("5")))
    )
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", written.alias("raw"), minor.alias("minor"))


@query("n07_money", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (1, 2, 3, 4) THEN -minor WHEN o_orderkey % 10 = 9 THEN minor + 1 ELSE minor END AS parsed
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders) t""")
def parsed_money(spark, sf):
    read = money.with_minor_units(_styled(spark, sf), {"parsed": "raw"}, F.lit("."), F.lit(","), F.lit(2))
    return read.select("o_orderkey", long("parsed"))


@query("n08_locale_guard", """
SELECT o_orderkey, (o_orderkey % 2 = 0 OR minor < 100000) AS readable FROM (
  SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders) t""")
def guard(spark, sf):
    minor = cents(F.col("o_totalprice"))
    us = F.format_number((minor.cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2)
    # Odd orders are written the European way, which a US reading must refuse.
    raw = F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(F.translate(us, ",.", " ,"))
    rows = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    read = money.with_minor_units(rows, {"m": "raw"}, F.lit("."), F.lit(","), F.lit(2))
    return read.select("o_orderkey", F.col("m").isNotNull().alias("readable"))


@query("n09_preview_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (1, 2, 3, 4) THEN -minor * 10 WHEN o_orderkey % 10 = 9 THEN minor * 10 + 5 ELSE minor * 10 END AS thousandths,
       false AS ambiguous
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders) t""")
def preview_numbers(spark, sf):
    read = money.with_preview_number(_styled(spark, sf).filter(F.col("raw").isNotNull()), {"v": "raw"})
    # A lone separator before three digits reads as grouping, so plain ".xx5" is not written here.
    return read.select("o_orderkey", (F.col("v") * 1000).cast("bigint").alias("thousandths"), F.col("v_ambiguous").alias("ambiguous"))


@query("n10_signed_amount", FX + "SELECT file_id, source_row, minor AS amount_minor, CASE WHEN locale <> 2 THEN balance_minor END AS balance_minor FROM fx")
def amounts(spark, sf):
    return normalize.normalise(cells(spark, sf), profile(spark, sf), meta(spark, sf)).select("file_id", "source_row", long("amount_minor"), long("balance_minor"))


@query("n11_preview_amount", FX + "SELECT file_id, source_row, CASE WHEN locale = 3 THEN abs(minor) ELSE minor END AS cents FROM fx")
def preview_amounts(spark, sf):
    from ledgerline.operators.quality import read_rows

    read = read_rows(cells(spark, sf), mapping(spark, sf), None)
    return read.select("file_id", "source_row", (F.col("signed") * 100).cast("bigint").alias("cents"))


@query("n12_transaction_type", FX + "SELECT file_id, type, count(*) AS n, CAST(sum(minor) AS BIGINT) AS total FROM tx GROUP BY ALL")
def types(spark, sf):
    return transactions(spark, sf).groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").cast("bigint").alias("total"))


@query("n13_fields", FX + """
SELECT file_id, source_row, name, memo, CASE WHEN reference <> '' THEN reference END AS reference_number, 'USD' AS currency, CAST(NULL AS DATE) AS date_user FROM tx""")
def fields(spark, sf):
    return transactions(spark, sf).select("file_id", "source_row", "name", "memo", "reference_number", "currency", "date_user")


@query("n14_rejects", FX + """
SELECT file_id, source_row AS row, CASE WHEN source_row % 50 = 49 THEN 'bad-date' ELSE 'bad-amount' END AS code,
       CASE WHEN source_row % 50 = 49 THEN 'Skipped row: "NOT-A-DATE" is not a date.' ELSE 'Skipped row: no parseable amount.' END AS message
FROM fx WHERE source_row % 50 = 49 OR source_row % 70 = 69""")
def rejects(spark, sf):
    rows = corrupt_cells(spark, sf)
    found = normalize.reject_issues(normalize.normalise(rows, profile(spark, sf), meta(spark, sf)))
    return found.select("file_id", "row", "code", "message")


_TOKENS = ["$", "USD", "CAD", "€", "EUR", "£", "GBP"]


def _currency_rows(spark, sf):
    """Orders as rows of 200-customer files, with a currency token per row."""
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (F.expr("(o_custkey div 200) % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END") + 1).cast("int"))
    return table(spark, sf, "orders").select(F.expr("o_custkey div 200").alias("file_no"), token.alias("token"))


_CANDS = ", ".join(f"('{t}', '{c}')" for t in _TOKENS for c in (rules.CURRENCY_CANDIDATES.get(t) or [t]))


@query("n15_currency_scan", f"""
WITH r AS (SELECT o_custkey // 200 AS file_no, ['{"','".join(_TOKENS)}'][CAST((o_custkey // 200) % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + 1 AS INT)] AS token FROM orders),
t AS (SELECT DISTINCT file_no, token FROM r), c(token, code) AS (VALUES {_CANDS}),
v AS (SELECT file_no, code, count(*) AS n FROM t JOIN c USING (token) GROUP BY ALL),
b AS (SELECT file_no, max(n) AS best FROM v GROUP BY ALL), n AS (SELECT file_no, count(*) AS tokens FROM t GROUP BY ALL)
SELECT file_no, tokens, best < tokens AS conflict FROM n JOIN b USING (file_no)""")
def currency_scan(spark, sf):
    return currency_conflicts(_currency_rows(spark, sf), ["file_no"], "token").select(long("file_no"), "tokens", "conflict")


@query("n16_outcomes", FX + """
SELECT file_id, CASE WHEN account % 7 = 3 THEN 'failed' ELSE 'converted' END AS outcome,
       CASE WHEN account % 7 = 3 THEN 0 ELSE count(*) FILTER (source_row % 50 <> 49 AND source_row % 70 <> 69) END AS transaction_count,
       CASE WHEN account % 7 = 3 THEN 0 ELSE count(*) FILTER (source_row % 50 = 49 OR source_row % 70 = 69) END AS warnings,
       CASE WHEN account % 7 = 3 THEN 'file-too-large' END AS failure_code
FROM fx GROUP BY file_id, account""")
def outcomes(spark, sf):
    files = headers(spark, sf)
    refused = files.filter(F.col("account") % 7 == 3).select(
        "file_id", F.lit(0).alias("ordinal"), F.lit("error").alias("level"), F.lit("file-too-large").alias("code"), F.lit("").alias("message"),
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("int").alias("column"),
    )
    return convert_rows(files, corrupt_cells(spark, sf), profile(spark, sf), refused).outcomes


@query("n17_render_money", """
SELECT o_orderkey, (CASE WHEN minor % 2 = 0 THEN '-' ELSE '' END) || (CASE o_orderkey % 3 WHEN 0 THEN CAST(minor AS VARCHAR)
  WHEN 1 THEN (minor // 100) || '.' || lpad(CAST(minor % 100 AS VARCHAR), 2, '0') ELSE (minor // 1000) || '.' || lpad(CAST(minor % 1000 AS VARCHAR), 3, '0') END) AS rendered
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders) t""")
def render_money(spark, sf):
    minor = cents(F.col("o_totalprice"))
    scale = F.when(F.col("o_orderkey") % 3 == 0, 0).when(F.col("o_orderkey") % 3 == 1, 2).otherwise(3)
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(minor % 2 == 0, -minor).otherwise(minor).alias("m"), scale.alias("scale"))
    return rows.select("o_orderkey", money.render_minor(F.col("m"), F.col("scale")).alias("rendered"))


@query("n18_render_dates", """
SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d%H%M%S') || '[0:GMT]' AS stamp FROM events""")
def render_dates(spark, sf):
    ts = F.col("ts").cast("timestamp")
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")
    day = F.to_date(ts)
    return table(spark, sf, "events").select("event_id", dates.render_date(day).alias("day"), dates.render_datetime(day, seconds, F.lit("[0:GMT]")).alias("stamp"))


_FOLD = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(strip_accents({0}), '[‘’‛]', '''', 'g'), '€', 'EUR'), '£', 'GBP'), '₹', 'INR'),
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[\t\n\r \x{{a0}}]+', ' ', 'g'), '[^\x00-\x7e]', '?', 'g')"""
_ESC = "trim(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"
_TEXT = _ESC.format(_FOLD.format("regexp_replace(regexp_replace(text, '[“”]', '\"', 'g'), '[‐-―]', '-', 'g')"))


@query("n19_markup_text", f"""
WITH t AS (SELECT doc_id AS id, 'd' AS kind, {_TEXT} AS x FROM documents UNION ALL
           SELECT conv_id * 1000 + turn AS id, 'c' AS kind, {_TEXT} AS x FROM conversations)
SELECT id, kind, CASE WHEN length(x) <= 255 THEN x ELSE rtrim(regexp_replace(substr(x, 1, 255), '&[^;&]*$', '')) END AS memo, md5(x) AS whole FROM t""")
def markup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), F.lit("d").alias("kind"), "text")
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("id"), F.lit("c").alias("kind"), "text")
    return d.unionByName(c).select("id", "kind", text.markup_text(F.col("text"), 255).alias("memo"), F.md5(text.escaped_text(F.col("text"))).alias("whole"))


@query("n20_id_tokens", """
SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '', 'g'), 1, 22) AS token FROM pages""")
def id_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.id_token(F.col("url"), 22).alias("token"))


# --- identity ------------------------------------------------------------------


@query("i01_fingerprint", FX + "SELECT file_id, source_row, base_id FROM ids")
def fingerprints(spark, sf):
    body = F.coalesce(F.col("memo"), F.col("name"))
    base = identity.fingerprint(F.col("account_id"), F.col("date_posted"), money.render_minor(F.col("amount_minor"), F.col("scale")), body)
    return transactions(spark, sf).select("file_id", "source_row", base.alias("base_id"))


def _fees(spark, sf):
    """Line items as monthly fee rows per supplier: many share one fingerprint."""
    minor = cents(F.col("l_tax"))
    rows = table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("file_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date_posted"),
        minor.alias("amount_minor"), F.col("l_linestatus").alias("name"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
    )
    day = rows.withColumn("day", F.to_date("l_shipdate"))
    numbered = skew.number_rows(day, ["file_id"], "day", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "source_row", whole_rows=skew.SLICE_ROWS)
    return numbered.select(
        "file_id", F.col("file_id").alias("account_id"), "source_row", "date_posted", F.col("amount_minor").cast(money.MINOR).alias("amount_minor"),
        F.lit(2).alias("scale"), "name", F.lit(None).cast("string").alias("memo"),
    )


@query("i02_fit_ids", """
WITH f AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS file_id, date_trunc('month', l_shipdate) AS m, CAST(CAST(l_tax AS DECIMAL(18,2)) * 100 AS BIGINT) AS c, l_linestatus AS s FROM lineitem),
b AS (SELECT file_id, upper(substr(sha1(file_id || '|' || strftime(m, '%Y%m%d') || '|0.' || lpad(CAST(c AS VARCHAR), 2, '0') || '|' || s), 1, 32)) AS base FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id, base) AS nth FROM b)
SELECT file_id, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS fit_id FROM n""")
def fit_ids(spark, sf):
    return identity.with_fit_ids(_fees(spark, sf)).select("file_id", "fit_id")


_STM = FX + """, stm AS (
  SELECT file_id, count(*) AS n, min(d) AS lo, max(d) AS hi, min_by(fit_id, source_row) AS f, max_by(fit_id, source_row) AS l,
         CASE WHEN locale = 2 THEN 0 ELSE max_by(balance_minor, source_row) END AS ledger FROM ident GROUP BY file_id, locale)"""


def _statements(spark, sf):
    return statements.statements(identity.with_fit_ids(transactions(spark, sf)), meta(spark, sf))


@query("i03_statement_uid", _STM + "SELECT file_id, upper(substr(sha1('' || chr(31) || file_id || chr(31) || n || chr(31) || f || chr(31) || l), 1, 32)) AS uid FROM stm")
def uids(spark, sf):
    return _statements(spark, sf).select("file_id", "uid")


_HEADS = "CASE locale WHEN 0 THEN 'Date|Description|Amount|Balance|Memo|Reference' WHEN 1 THEN 'Date|Description|Debit|Credit|Balance|Memo|Reference' WHEN 2 THEN 'Posting Date|Particulars|Amount|Running Bal.|Notes|Ref' ELSE 'Transaction Date|Details|Value|Type|Balance|Memo|Reference' END"


@query("i04_source_digest", CELLS + f""", wrote AS (
  SELECT *, file_id || '-' || (source_row // 2000) AS file, {_HEADS} AS heads, ([',', ';', '|', chr(9)])[locale + 1] AS sep FROM drawn),
lines AS (SELECT *, list_reduce(list_transform(cells, lambda c: CASE WHEN contains(c, sep) OR contains(c, chr(34)) OR contains(c, chr(10)) THEN chr(34) || replace(c, chr(34), chr(34) || chr(34)) || chr(34) ELSE c END), lambda a, b: a || sep || b) AS line FROM wrote),
txt AS (
  SELECT file, file_id, locale, heads, count(*) AS n, CASE WHEN account % 3 = 0 THEN 'Account Statement' || chr(13) || chr(10) || 'Account: ' || file_id || chr(13) || chr(10) || chr(13) || chr(10) ELSE '' END ||
         replace(heads, '|', sep) || chr(13) || chr(10) || array_to_string(list(line), chr(13) || chr(10)) || chr(13) || chr(10) || 'End of statement' || chr(13) || chr(10) AS t
  FROM lines GROUP BY file, file_id, account, locale, heads, sep)
SELECT file AS file_id, sha1((CASE locale WHEN 0 THEN 3 + strlen(t) WHEN 1 THEN 2 + 2 * length(t) WHEN 2 THEN length(t) ELSE strlen(t) END) || ':' || replace(heads, '|', chr(31)) || ':' || n) AS digest FROM txt""")
def digests(spark, sf):
    return inspect_files(files(spark, sf)).files.select("file_id", F.col("source_digest").alias("digest"))


# --- statements ------------------------------------------------------------------


@query("a01_period", _STM + "SELECT file_id, lo AS period_start, hi AS period_end FROM stm")
def period(spark, sf):
    return _statements(spark, sf).select("file_id", "period_start", "period_end")


@query("a02_ledger_balance", _STM + "SELECT file_id, CAST(ledger AS BIGINT) AS ledger_minor FROM stm")
def ledger(spark, sf):
    return _statements(spark, sf).select("file_id", long("ledger_minor"))


@query("a03_as_of", _STM + "SELECT file_id, strftime(hi, '%Y%m%d') || '000000[0:GMT]' AS as_of FROM stm")
def as_of_dates(spark, sf):
    stamp = dates.render_datetime(F.col("as_of_date"), F.col("as_of_seconds"), F.col("time_zone_suffix"))
    return _statements(spark, sf).select("file_id", stamp.alias("as_of"))


@query("a04_statement_rows", _STM + """
SELECT file_id, file_id AS account_id, 'CHECKING' AS account_type, 'USD' AS currency, 'BANK' AS institution, n AS transaction_count, lo AS period_start, hi AS period_end,
       CAST(ledger AS BIGINT) AS ledger_minor FROM stm""")
def statement_rows(spark, sf):
    return _statements(spark, sf).select("file_id", "account_id", "account_type", "currency", "institution", "transaction_count", "period_start", "period_end", long("ledger_minor"))


@query("a06_row_band", """
SELECT o_custkey AS user_id, count(*) AS n, CASE WHEN count(*) <= 50 THEN '1-50' WHEN count(*) <= 200 THEN '51-200' WHEN count(*) <= 1000 THEN '201-1000' ELSE '1000+' END AS band
FROM orders GROUP BY o_custkey UNION ALL
SELECT -1 - l_suppkey, count(*), CASE WHEN count(*) <= 50 THEN '1-50' WHEN count(*) <= 200 THEN '51-200' WHEN count(*) <= 1000 THEN '201-1000' ELSE '1000+' END FROM lineitem GROUP BY l_suppkey""")
def bands(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "lineitem").groupBy((-1 - F.col("l_suppkey")).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).withColumn("band", classify.row_band(F.col("n")))


@query("s08_download_names", """
SELECT page_id, CASE WHEN s = '' THEN 'statement' ELSE s END || '_converted.' || (['ofx', 'qbo', 'qfx'])[page_id % 3 + 1] AS name FROM (
  SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(url, '\\.[^.]+$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS s FROM pages) t""")
def names(spark, sf):
    dialect = F.element_at(F.array(*[F.lit(d) for d in rules.DIALECTS]), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", text.download_name(F.col("url"), dialect).alias("name"))


@query("s11_account_keys", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ACC' || page_id ELSE regexp_replace(url, '\\.[^.]+$', '') END AS account_id FROM pages""")
def account_keys(spark, sf):
    supplied = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" ACC"), F.col("page_id"), F.lit(" "))).when(F.col("page_id") % 4 == 1, F.lit("  "))
    return table(spark, sf, "pages").select("page_id", text.account_key(supplied, F.col("url")).alias("account_id"))


def _leaf(tag, value):
    return f"'            <{tag}>' || {value} || chr(13) || chr(10)"


_BLOCKS = _STM + f""", blk AS (
  SELECT file_id, source_row, '          <STMTTRN>' || chr(13) || chr(10) || {_leaf('TRNTYPE', 'type')} || {_leaf('DTPOSTED', "strftime(d, '%Y%m%d') || CASE WHEN locale = 3 THEN lpad(CAST((k % 86400) // 3600 AS VARCHAR), 2, '0') || lpad(CAST((k % 3600) // 60 AS VARCHAR), 2, '0') || lpad(CAST(k % 60 AS VARCHAR), 2, '0') ELSE '' END")} ||
    {_leaf('TRNAMT', 'amount_text')} || {_leaf('FITID', 'fit_id')} || CASE WHEN reference <> '' THEN {_leaf('REFNUM', 'reference')} ELSE '' END ||
    {_leaf('NAME', "rtrim(regexp_replace(substr(replace(replace(replace(replace(name, 'É', 'E'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 1, 32), CASE WHEN length(name) + 10 <= 32 THEN '^$' ELSE '&[^;&]*$' END, ''))")} ||
    CASE WHEN memo IS NOT NULL THEN {_leaf('MEMO', 'memo')} ELSE '' END || '          </STMTTRN>' || chr(13) || chr(10) AS block FROM ident)
"""


@query("s07_documents", _BLOCKS + "SELECT file_id, count(*) AS blocks, md5(string_agg(block, '' ORDER BY source_row)) AS body FROM blk GROUP BY file_id")
def document_bodies(spark, sf):
    from ledgerline.operators.statements import CRLF, documents

    from ledgerline.sources.documents import digests_of_files

    # Rows without a file id are one statement, too: its parts are found under a name.
    named = {"file_id": F.coalesce("file_id", F.lit(""))}
    identified = identity.with_fit_ids(transactions(spark, sf)).withColumns(named)
    docs = documents(identified, statements.statements(identified, meta(spark, sf).withColumns(named)), "qbo")
    # All but the opening lines of the first part and the closing lines of the last.
    inside = F.substring_index(F.element_at(F.split("text", r"<DTEND>[0-9]{8}\r\n"), -1), "        </BANKTRANLIST>", 1)
    blocks = F.regexp_count("text", F.lit("<STMTTRN>")).cast("bigint")
    found = digests_of_files(docs.select("file_id", "part", "parts", blocks.alias("blocks"), inside.alias("text")))
    return found.select(F.nullif("file_id", F.lit("")).alias("file_id"), "blocks", F.col("digest").alias("body"))


@query("s07_statement_files", _BLOCKS + """
SELECT md5(file_id) AS file_key, 'qbo' AS dialect, count(*) AS blocks, md5(string_agg(block, '' ORDER BY source_row)) AS body, true AS whole FROM blk GROUP BY file_id""")
def statement_files(spark, sf):
    """The written files themselves, one a statement, of parts of at most 50 rows."""
    from ledgerline.operators.statements import documents
    from ledgerline.session import work_dir
    from ledgerline.sources.documents import write_statement_files

    identified = identity.with_fit_ids(transactions(spark, sf))
    parts = documents(identified, statements.statements(identified, meta(spark, sf), rows_per_part=50), "qbo", rows_per_part=50)
    path = work_dir(spark, "statements")
    write_statement_files(parts, headers(spark, sf).select("file_id", F.concat("file_id", F.lit(".csv")).alias("file_name")), path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.split("path", "/").alias("p"), F.col("content").cast("string").alias("text"))
    body = F.substring_index(F.element_at(F.split("text", r"<DTEND>[0-9]{8}\r\n"), 2), "        </BANKTRANLIST>", 1)
    whole = F.startswith(F.col("text"), F.lit("OFXHEADER:100\r\n")) & F.endswith(F.col("text"), F.lit("</OFX>\r\n"))
    return found.select(
        F.element_at("p", -2).alias("file_key"), F.element_at("p", -3).alias("dialect"), F.regexp_count("text", F.lit("<STMTTRN>")).cast("bigint").alias("blocks"), F.md5(body).alias("body"), whole.alias("whole")
    )
