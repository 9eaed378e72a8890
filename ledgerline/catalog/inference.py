"""Column roles and formats per file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.catalog.common import CELLS, FX, cells, headers, long, mapping, query
from ledgerline.functions.text import header_key, layout_key
from ledgerline.operators import banks, columns, formats, layout
from ledgerline.sources.tables import table

# Per locale: position, header, role after contention, confidence.
_MAPPED = [
    [("Date", "date", 1.0), ("Description", "description", 1.0), ("Amount", "amount", 1.0), ("Balance", "balance", 1.0), ("Memo", "memo", 1.0), ("Reference", "referenceNumber", 1.0)],
    [("Date", "date", 1.0), ("Description", "description", 1.0), ("Debit", "debit", 1.0), ("Credit", "credit", 1.0), ("Balance", "balance", 1.0), ("Memo", "memo", 1.0), ("Reference", "referenceNumber", 1.0)],
    [("Posting Date", "postedDate", 1.0), ("Particulars", "description", 1.0), ("Amount", "amount", 1.0), ("Running Bal.", "ignored", 0.0), ("Notes", "memo", 1.0), ("Ref", "referenceNumber", 1.0)],
    [("Transaction Date", "date", 1.0), ("Details", "description", 1.0), ("Value", "amount", 0.9), ("Type", "type", 1.0), ("Balance", "balance", 1.0), ("Memo", "memo", 1.0), ("Reference", "referenceNumber", 1.0)],
]
_VALUES = ", ".join(f"({loc}, {i}, '{h}', '{r}', {c})" for loc, cols in enumerate(_MAPPED) for i, (h, r, c) in enumerate(cols))
ACCTS = f"""
WITH acct AS (SELECT DISTINCT o_custkey // 40 AS account, lpad(CAST(o_custkey // 40 AS VARCHAR), 9, '0') AS file_id, (o_custkey // 40) % 4 AS locale FROM orders),
m(locale, col_index, header, role, confidence) AS (VALUES {_VALUES}),
mp AS (SELECT file_id, account, locale, CAST(col_index AS BIGINT) AS col_index, header, role, CAST(confidence AS DOUBLE) AS confidence, locale FROM acct JOIN m USING (locale))
"""


def _wide(df):
    return df.withColumn("col_index", F.col("col_index").cast("bigint"))


@query("l05_column_samples", FX + """
SELECT file_id, CAST(CASE locale WHEN 0 THEN 6 WHEN 2 THEN 6 ELSE 7 END AS BIGINT) AS columns, count(*) AS sampled, count(*) FILTER (description <> '') AS described
FROM fx WHERE source_row < 200 GROUP BY file_id, locale""")
def samples(spark, sf):
    s = columns.column_samples(cells(spark, sf))
    return s.groupBy("file_id").agg(
        F.count_distinct("col_index").alias("columns"), F.count_if(F.col("col_index") == 0).alias("sampled"),
        F.count_if((F.col("col_index") == 1) & (F.col("value") != "")).alias("described"),
    )


@query("s06_preview", FX + "SELECT file_id, source_row, description FROM fx WHERE source_row < 20")
def previews(spark, sf):
    return layout.preview(cells(spark, sf)).select("file_id", "source_row", "description")


@query("c01_header_roles", ACCTS + """
SELECT file_id, col_index, CASE WHEN header = 'Running Bal.' THEN NULL ELSE role END AS header_role, CASE WHEN header = 'Running Bal.' THEN NULL ELSE confidence END AS header_confidence FROM mp""")
def header_roles(spark, sf):
    return _wide(columns.with_header_role(columns.explode_headers(headers(spark, sf)))).select("file_id", "col_index", "header_role", "header_confidence")


# What every cell is by its typed source: D date, N number, T text of three characters or more, S shorter text, '' blank.
KINDS = FX + """, kind AS (
  SELECT file_id, CASE WHEN description = '' THEN '' WHEN length(description) < 3 THEN 'S' ELSE 'T' END AS ds, CASE WHEN memo_cell = '' THEN '' WHEN length(memo_cell) < 3 THEN 'S' ELSE 'T' END AS me,
         CASE WHEN reference = '' THEN '' WHEN length(reference) < 3 THEN 'S' ELSE 'T' END AS re, minor, locale FROM fx),
cell_kind AS (
  SELECT file_id, unnest(ks) AS kind, generate_subscripts(ks, 1) - 1 AS col_index FROM (
    SELECT file_id, CASE locale WHEN 1 THEN ['D', ds, CASE WHEN minor < 0 THEN 'N' ELSE '' END, CASE WHEN minor < 0 THEN '' ELSE 'N' END, 'N', me, re]
                                WHEN 3 THEN ['D', ds, 'N', 'S', 'N', me, re] ELSE ['D', ds, 'N', 'N', me, re] END AS ks FROM kind)),
ratio AS (
  SELECT file_id, CAST(col_index AS BIGINT) AS col_index, count(*) FILTER (kind <> '') AS filled, count(*) FILTER (kind = 'D') / count(*) FILTER (kind <> '') AS date,
         count(*) FILTER (kind = 'N') / count(*) FILTER (kind <> '') AS number, count(*) FILTER (kind IN ('T', 'D')) / count(*) FILTER (kind <> '') AS txt FROM cell_kind GROUP BY ALL)
"""


@query("c02_content_roles", KINDS + """
SELECT file_id, col_index, CASE WHEN date >= 0.8 THEN 'date' WHEN number >= 0.9 THEN 'amount' WHEN txt >= 0.7 THEN 'description' END AS content_role,
       round(CASE WHEN date >= 0.8 THEN date * 0.8 WHEN number >= 0.9 THEN number * 0.5 WHEN txt >= 0.7 THEN txt * 0.5 END, 6) AS content_confidence FROM ratio""")
def content_roles(spark, sf):
    profiled = columns.with_content_role(columns.profile_content(columns.column_samples(cells(spark, sf), None)))
    return _wide(profiled).select("file_id", "col_index", "content_role", F.round("content_confidence", 6).alias("content_confidence"))


@query("c03_combined_roles", ACCTS + """
SELECT file_id, col_index, CASE WHEN header = 'Running Bal.' THEN 'amount' ELSE role END AS role, CASE WHEN header = 'Running Bal.' THEN 0.5 ELSE confidence END AS confidence FROM mp""")
def combined(spark, sf):
    return _wide(columns.draft_roles(headers(spark, sf), columns.column_samples(cells(spark, sf), None))).select("file_id", "col_index", "role", "confidence")


@query("c04_contention", ACCTS + "SELECT file_id, col_index, header, role, confidence FROM mp")
def contention(spark, sf):
    return _wide(columns.map_columns(headers(spark, sf), cells(spark, sf))).select("file_id", "col_index", "header", "role", "confidence")


_LAYOUT = ", ".join(f"('{s}', {i}, '{h}')" for s, *_, hs in rules.BANK_LAYOUTS for i, h in enumerate(hs))
_WORDS = ", ".join(f"({i}, '{r}', '{w}')" for i, (r, ws) in enumerate(rules.LAYOUT_KEYWORDS) for w in ws)
_SLUGS = ", ".join(f"({i}, '{x[0]}')" for i, x in enumerate(rules.BANK_LAYOUTS))
LAYOUTS = f"""
WITH lay(bank_slug, position, header) AS (VALUES {_LAYOUT}), word(ord, role, word) AS (VALUES {_WORDS}), slug(no, bank_slug) AS (VALUES {_SLUGS}),
k AS (SELECT *, trim(lower(header)) AS key FROM lay),
hit AS (SELECT bank_slug, position, header, key, role, CASE WHEN key = word THEN 0 ELSE 1 END AS pass, ord FROM k JOIN word ON contains(key, word)),
best AS (SELECT bank_slug, position, first(role ORDER BY pass, ord) AS role FROM hit GROUP BY ALL),
derived AS (SELECT k.bank_slug, k.position, k.header, k.key, coalesce(best.role, 'ignored') AS role FROM k LEFT JOIN best USING (bank_slug, position)),
resolved AS (SELECT *, CASE WHEN role <> 'ignored' AND position < max(position) OVER (PARTITION BY bank_slug, role) THEN 'ignored' ELSE role END AS preset FROM derived),
cust AS (SELECT c_custkey, bank_slug FROM customer JOIN slug ON c_custkey % 20 = no)
"""


def _customer_layouts(spark, sf):
    """Every customer declares one of the twenty layouts."""
    slugs = F.element_at(F.array(*[F.lit(x[0]) for x in rules.BANK_LAYOUTS]), (F.col("c_custkey") % 20 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", slugs.alias("bank_slug"))


@query("c05_layout_roles", LAYOUTS + "SELECT role, header, count(*) AS customers FROM cust JOIN derived USING (bank_slug) GROUP BY ALL")
def layout_roles(spark, sf):
    joined = _customer_layouts(spark, sf).join(F.broadcast(columns.layout_headers(spark)), "bank_slug")
    return joined.groupBy(F.col("layout_role").alias("role"), "header").agg(F.count(F.lit(1)).alias("customers"))


@query("c06_preset_roles", LAYOUTS + "SELECT c_custkey, CAST(position AS BIGINT) AS position, preset FROM cust JOIN resolved USING (bank_slug)")
def preset(spark, sf):
    joined = _customer_layouts(spark, sf).join(F.broadcast(columns.layout_headers(spark)), "bank_slug")
    return columns.preset_roles(joined, ["c_custkey"], "position", "layout_role").select("c_custkey", long("position"), F.col("preset_role").alias("preset"))


def _declared(spark, sf):
    slugs = F.element_at(F.array(*[F.lit(x[0]) for x in rules.BANK_LAYOUTS]), (F.col("account") % 20 + 1).cast("int"))
    return headers(spark, sf).select("file_id", slugs.alias("bank_slug"))


_APPLIED = ACCTS + "," + LAYOUTS.replace("WITH lay", " lay") + """, keyed AS (SELECT DISTINCT bank_slug, key, role AS wanted FROM derived),
j AS (SELECT mp.*, d.wanted FROM mp JOIN slug ON mp.account % 20 = slug.no LEFT JOIN keyed d ON d.bank_slug = slug.bank_slug AND d.key = lower(mp.header)),
p AS (SELECT *, CASE WHEN wanted <> 'ignored' AND col_index < max(col_index) OVER (PARTITION BY file_id, wanted) THEN 'ignored' ELSE wanted END AS preset FROM j)"""


@query("c07_apply_preset", _APPLIED + """
SELECT file_id, col_index, coalesce(preset, role) AS role, CASE WHEN preset = 'ignored' THEN 0.0 WHEN preset IS NOT NULL THEN 1.0 ELSE confidence END AS confidence FROM p""")
def apply_preset(spark, sf):
    out = columns.apply_preset(mapping(spark, sf), _declared(spark, sf), columns.layout_headers(spark))
    return _wide(out).select("file_id", "col_index", "role", "confidence")


@query("c08_overrides", ACCTS + """
SELECT file_id, col_index, CASE WHEN col_index = 2 THEN 'balance' WHEN role = 'balance' THEN 'ignored' ELSE role END AS role,
       CASE WHEN col_index = 2 THEN 1.0 WHEN role = 'balance' THEN 0.0 ELSE confidence END AS confidence, (col_index = 2 OR role = 'balance') AS user_assigned FROM mp""")
def overrides(spark, sf):
    chosen = headers(spark, sf).select("file_id", F.lit(2).alias("col_index"), F.lit("balance").alias("role"))
    return _wide(columns.apply_overrides(mapping(spark, sf), chosen)).select("file_id", "col_index", "role", "confidence", "user_assigned")


@query("c09_convention", ACCTS + "SELECT file_id, CASE locale WHEN 1 THEN 'debit-credit' WHEN 3 THEN 'magnitude-with-indicator' ELSE 'signed' END AS convention FROM acct")
def convention(spark, sf):
    return columns.roles_by_file(mapping(spark, sf)).select("file_id", columns.amount_convention().alias("convention"))


@query("c10_mapping_view", ACCTS + "," + CELLS.replace("WITH base", " base") + """,
one AS (SELECT file_id, source_row, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS col_index FROM drawn),
s AS (SELECT file_id, col_index, min_by(value, source_row) AS sample FROM one WHERE value <> '' GROUP BY ALL)
SELECT mp.file_id, mp.col_index, mp.header, mp.role, coalesce(sample, '—') AS sample, true AS has_date, true AS has_description, true AS has_amount,
       CASE locale WHEN 1 THEN 'debit / credit pair' ELSE 'signed amount' END AS convention_label
FROM mp LEFT JOIN s ON s.file_id = mp.file_id AND s.col_index = mp.col_index""")
def mapping_view(spark, sf):
    view = columns.mapping_view(cells(spark, sf), mapping(spark, sf))
    return _wide(view).select("file_id", "col_index", "header", "role", "sample", "has_date", "has_description", "has_amount", "convention_label")


@query("c11_column_issues", ACCTS + """
SELECT file_id, 'no-date-column' AS code, 'error' AS level FROM acct WHERE account % 3 = 0 UNION ALL
SELECT file_id, 'no-amount-column', 'error' FROM acct WHERE account % 3 = 1""")
def column_issues(spark, sf):
    # Every third file loses its date columns, the next third its money columns.
    account = F.col("file_id").cast("bigint") % 3
    lost = ((account == 0) & F.col("role").isin("date", "postedDate")) | ((account == 1) & F.col("role").isin("amount", "debit", "credit", "balance"))
    cut = mapping(spark, sf).withColumn("role", F.when(lost, "ignored").otherwise(F.col("role")))
    rows = cells(spark, sf)
    profiled = formats.profile_formats(rows, cut)
    found = layout.column_issues(profiled, formats.amount_samples(rows, profiled))
    # A file without a date column samples nothing, so it can say nothing more.
    return found.select("file_id", "code", "level")


# --- formats -------------------------------------------------------------------


def _roles(spark, sf):
    return columns.roles_by_file(mapping(spark, sf))


@query("f01_date_order", FX + """
SELECT file_id, CASE WHEN locale = 3 THEN 'YMD' WHEN locale = 1 AND max(day(d)) > 12 THEN 'DMY' ELSE 'MDY' END AS date_order, (locale = 3) AS has_time,
       (locale <> 3 AND max(day(d)) <= 12) AS ambiguous, 1.0 AS confidence FROM fx GROUP BY file_id, locale""")
def date_order(spark, sf):
    found = formats.infer_dates(formats.date_samples(cells(spark, sf), _roles(spark, sf)))
    return found.select("file_id", "date_order", F.col("date_has_time").alias("has_time"), F.col("date_ambiguous").alias("ambiguous"), F.col("date_confidence").alias("confidence"))


@query("f02_preview_order", FX + """
SELECT file_id, CASE WHEN locale = 3 THEN 'ISO' WHEN locale = 1 AND max(day(d)) > 12 THEN 'DMY' WHEN max(day(d)) > 12 THEN 'MDY' ELSE 'AMBIGUOUS' END AS preview_order
FROM fx GROUP BY file_id, locale""")
def preview_order(spark, sf):
    return formats.infer_preview_order(formats.date_samples(cells(spark, sf), _roles(spark, sf), None))


@query("f03_number_format", FX + """
SELECT file_id, CASE locale WHEN 1 THEN ',' ELSE '.' END AS decimal_separator, CASE locale WHEN 1 THEN '.' WHEN 3 THEN NULL ELSE ',' END AS group_separator,
       (locale = 2 AND bool_or(minor < 0)) AS parentheses_negative, false AS trailing_sign FROM fx GROUP BY file_id, locale""")
def number_format(spark, sf):
    found = formats.infer_numbers(formats.amount_samples(cells(spark, sf), _roles(spark, sf)))
    return found.select("file_id", "decimal_separator", "group_separator", "parentheses_negative", "trailing_sign")


@query("f04_currency_tokens", FX + "SELECT file_id, CASE WHEN locale = 2 THEN '$' ELSE '' END AS symbols FROM fx GROUP BY file_id, locale")
def currency_tokens(spark, sf):
    found = formats.infer_numbers(formats.amount_samples(cells(spark, sf), _roles(spark, sf)))
    return found.select("file_id", F.array_join("stripped_symbols", ",").alias("symbols"))


def _symbol_rows(spark, sf):
    """Orders in files of 200 customers, an amount cell with one of three marks."""
    mark = F.element_at(F.array(*[F.lit(t) for t in ("$", "USD ", "€")]), (F.expr("(o_custkey div 200) % 3 * (o_orderkey % 2)") + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.expr("o_custkey div 200").cast("string").alias("file_id"), F.concat(mark, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value")
    )


@query("f05_currency_collision", """
WITH r AS (SELECT CAST(o_custkey // 200 AS VARCHAR) AS file_id, (o_custkey // 200) % 3 * (o_orderkey % 2) AS mark FROM orders)
SELECT file_id, (bool_or(mark = 2) AND bool_or(mark < 2)) AS conflict FROM r GROUP BY file_id""")
def collisions(spark, sf):
    found = formats.infer_numbers(_symbol_rows(spark, sf))
    return found.select("file_id", formats.tokens_conflict(F.col("stripped_symbols")).alias("conflict"))


# --- bank layouts ----------------------------------------------------------------

_DIM = ", ".join("('" + "', '".join(x[:7]) + "')" for x in rules.BANK_LAYOUTS)
_DIMS = f"WITH dim(bank_slug, bank_name, product, region, date_order, amount_mode, confidence) AS (VALUES {_DIM}), slug(no, bank_slug) AS (VALUES {_SLUGS}), f AS (SELECT e.event_id, s.bank_slug FROM events e JOIN slug s ON e.user_id % 20 = s.no)"


def _facts(spark, sf):
    slugs = F.element_at(F.array(*[F.lit(x[0]) for x in rules.BANK_LAYOUTS]), (F.col("user_id") % 20 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", slugs.alias("bank_slug"))


@query("b01_enrich", _DIMS + """
SELECT event_id, bank_slug, bank_name, product, region, date_order, amount_mode, CASE product WHEN 'checking' THEN 'checking account' WHEN 'credit-card' THEN 'credit card' ELSE 'account statement' END AS account_kind,
       false AS verified, '2026-09-05' AS last_reviewed FROM f LEFT JOIN dim USING (bank_slug)""")
def enriched(spark, sf):
    return banks.enrich(_facts(spark, sf)).select("event_id", "bank_slug", "bank_name", "product", "region", "date_order", "amount_mode", "account_kind", "verified", "last_reviewed")


@query("b02_trust_gate", _DIMS + """
SELECT 'reviewed' AS gate, count(*) AS events FROM f JOIN dim USING (bank_slug) WHERE confidence <> 'unverified' UNION ALL
SELECT 'unverified', count(*) FROM f JOIN dim USING (bank_slug) WHERE confidence <> 'verified' UNION ALL
SELECT 'publishable', count(*) FROM f JOIN dim USING (bank_slug) WHERE confidence = 'verified'""")
def gates(spark, sf):
    def one(level):
        return banks.gate(_facts(spark, sf), level).agg(F.count(F.lit(1)).alias("events")).select(F.lit(level).alias("gate"), "events")

    return one("reviewed").unionByName(one("unverified")).unionByName(one("publishable"))


@query("b03_market", _DIMS + """
SELECT event_id, CASE region WHEN 'UK' THEN 'UK' WHEN 'EU' THEN 'EU' ELSE 'US' END AS market, CASE region WHEN 'UK' THEN 'GBP' WHEN 'EU' THEN 'EUR' ELSE 'USD' END AS market_currency, (region IN ('UK', 'EU')) AS uk_or_eu
FROM f LEFT JOIN dim USING (bank_slug)""")
def markets(spark, sf):
    return banks.with_market(banks.enrich(_facts(spark, sf))).select("event_id", "market", "market_currency", "uk_or_eu")


@query("b04_declared_vs_observed", ACCTS + "," + LAYOUTS.replace("WITH lay", " lay") + """
SELECT a.file_id, r.bank_slug, CAST(r.position + 1 AS BIGINT) AS position, r.header, r.preset AS preselected, m2.role AS observed_role, (m2.role IS NOT NULL) AS present
FROM acct a JOIN slug ON a.account % 20 = slug.no JOIN resolved r ON r.bank_slug = slug.bank_slug LEFT JOIN mp m2 ON m2.file_id = a.file_id AND lower(m2.header) = r.key""")
def declared_observed(spark, sf):
    out = banks.compare_layouts(mapping(spark, sf), _declared(spark, sf))
    return out.select("file_id", "bank_slug", long("position"), "header", "preselected", "observed_role", "present")
