"""Which role each column of a file plays.

Works on one long table, a row per file and column:
``(file_id, col_index, header, role, confidence, user_assigned)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerline import rules
from ledgerline.functions.dates import day_text, is_day_text
from ledgerline.functions.money import looks_numeric
from ledgerline.functions.text import first_match, header_key, layout_key, strip

MAPPING = ["file_id", "col_index", "header", "role", "confidence", "user_assigned"]


def column_samples(rows: DataFrame, sample_rows: int | None = rules.SAMPLE_ROWS) -> DataFrame:
    """The first body rows of every file, all of them for ``None``, one row per cell."""
    head = rows if sample_rows is None else rows.filter(F.col("source_row") < sample_rows)
    return head.select(
        "file_id", "source_row", F.posexplode("cells").alias("col_index", "value")
    )


def explode_headers(headers: DataFrame) -> DataFrame:
    return headers.select("file_id", F.posexplode("headers").alias("col_index", "header"))


# --- header text ------------------------------------------------------------


def with_header_role(df: DataFrame, header: str = "header") -> DataFrame:
    """Add ``header_role`` and ``header_confidence`` from the ordered rules."""
    keyed = df.withColumn("__key", header_key(F.col(header)))
    role = first_match(F.col("__key"), [(p, r) for r, p, _ in rules.HEADER_RULES])
    weight = first_match(F.col("__key"), [(p, w) for _, p, w in rules.HEADER_RULES])
    known = F.col("__key") != ""
    return keyed.withColumns({"header_role": F.when(known, role), "header_confidence": F.when(known, weight)}).drop("__key")


# --- column content ---------------------------------------------------------


def profile_content(samples: DataFrame) -> DataFrame:
    """Ratios over the non-blank samples of each column."""
    trimmed = samples.withColumn("value", strip(F.col("value")))
    dated = trimmed.withColumn("day", day_text(F.col("value"))).withColumns({"dated": is_day_text(F.col("day")), "numeric": looks_numeric(F.col("value"))})
    filled = F.col("value") != ""

    def share(condition: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(filled & condition), F.count_if(filled)), F.lit(0.0))

    return dated.groupBy("file_id", "col_index").agg(
        F.count_if(filled).alias("filled"),
        share(F.col("dated")).alias("date_ratio"),
        share(F.col("numeric")).alias("numeric_ratio"),
        share(~F.col("numeric") & (F.length("value") >= 3)).alias("text_ratio"),
        share(~F.col("numeric")).alias("nonnumeric_ratio"),
    )


def with_content_role(profile: DataFrame) -> DataFrame:
    date, number, text = F.col("date_ratio"), F.col("numeric_ratio"), F.col("text_ratio")
    return profile.withColumns(
        {
            "content_role": F.when(date >= 0.8, "date").when(number >= 0.9, "amount").when(text >= 0.7, "description"),
            "content_confidence": F.when(date >= 0.8, date * 0.8).when(number >= 0.9, number * 0.5).when(text >= 0.7, text * 0.5),
        }
    )


# --- combination and contention ---------------------------------------------


def draft_roles(headers: DataFrame, samples: DataFrame) -> DataFrame:
    """Header against content, before columns of a file compete."""
    by_header = with_header_role(explode_headers(headers))
    by_content = with_content_role(profile_content(samples))
    both = by_header.join(by_content, ["file_id", "col_index"], "left")
    header, content = F.col("header_confidence"), F.col("content_confidence")
    header_wins = header.isNotNull() & ((header >= 0.9) | content.isNull() | (header >= content))
    return both.select(
        "file_id",
        "col_index",
        strip(F.col("header")).alias("header"),
        F.when(header_wins, F.col("header_role")).otherwise(F.coalesce("content_role", F.lit("ignored"))).alias("role"),
        F.when(header_wins, header).otherwise(F.coalesce(content, F.lit(0.0))).alias("confidence"),
        F.lit(False).alias("user_assigned"),
        (F.coalesce("nonnumeric_ratio", F.lit(0.0)) >= 0.7).alias("textual"),
    )


def resolve_contention(draft: DataFrame) -> DataFrame:
    """One column per single-slot role.

    A strictly higher confidence takes the role over, ties keep the lower index.
    Columns meet in index order, so each loser has the index at which it lost;
    the first textual loser becomes ``memo`` when the file has none.
    """
    index, confidence = F.col("col_index"), F.col("confidence")
    slot = F.col("role").isin(rules.SINGLE_SLOT_ROLES)
    file = W.partitionBy("file_id")
    same = W.partitionBy("file_id", "role").orderBy("col_index")
    before = same.rowsBetween(W.unboundedPreceding, -1)
    after = same.rowsBetween(1, W.unboundedFollowing)

    out = draft.withColumn("__led", F.coalesce(confidence > F.max("confidence").over(before), F.lit(True)))
    out = out.withColumn("__next", F.min(F.when(F.col("__led"), index)).over(after))
    lost_at = F.when(slot & ~F.col("__led"), index).when(slot, F.col("__next"))
    out = out.withColumn("__lost", lost_at)
    out = out.withColumns(
        {
            "__memo": F.max((F.col("role") == "memo").cast("int")).over(file),
            "__first": F.min(F.when(F.col("textual"), F.col("__lost"))).over(file),
        }
    )
    to_memo = F.col("textual") & (F.col("__memo") == 0) & (F.col("__lost") == F.col("__first"))
    lost = F.col("__lost").isNotNull()
    return out.withColumns(
        {
            "role": F.when(lost & to_memo, "memo").when(lost, "ignored").otherwise(F.col("role")),
            "confidence": F.when(lost, F.lit(0.0)).otherwise(confidence),
        }
    ).select(*MAPPING)


def map_columns(headers: DataFrame, rows: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Roles from the headers and all rows; ``sample_rows`` looks at the first ones only."""
    return resolve_contention(draft_roles(headers, column_samples(rows, sample_rows)))


# --- declared layouts and overrides -----------------------------------------


def layout_role(header: Column) -> Column:
    """Role a declared header is pre-selected as: exact keyword, else contained."""
    key = layout_key(header)
    exact, inside = F, F
    for role, words in rules.LAYOUT_KEYWORDS:
        exact = exact.when(key.isin(words), F.lit(role))
        hit = F.contains(key, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(key, F.lit(word))
        inside = inside.when(hit, F.lit(role))
    return F.coalesce(exact.otherwise(F.lit(None)), inside.otherwise(F.lit("ignored")))


def layout_headers(spark: SparkSession) -> DataFrame:
    """Headers of the bank layouts with the role derived from each."""
    data = [(x[0], i, h) for x in rules.BANK_LAYOUTS for i, h in enumerate(x[7])]
    df = spark.createDataFrame(data, "bank_slug string, position int, header string")
    return df.withColumns({"header_key": layout_key(F.col("header")), "layout_role": layout_role(F.col("header"))})


def preset_roles(columns: DataFrame, keys: list[str], index: str, role: str) -> DataFrame:
    """Keep one column per role: the last claimant wins, the others are ignored.

    An unknown header (NULL role) and ``ignored`` pass through.
    """
    last = F.max(index).over(W.partitionBy(*keys, role))
    claim = F.col(role).isNotNull() & (F.col(role) != "ignored")
    return columns.withColumn("preset_role", F.when(claim & (F.col(index) != last), "ignored").otherwise(F.col(role)))


def apply_preset(mapping: DataFrame, declared: DataFrame, layouts: DataFrame) -> DataFrame:
    """Lay a file's declared bank layout over the inferred roles.

    ``declared`` is ``(file_id, bank_slug)``; ``layouts`` comes from
    `layout_headers`, 120 rows, hence the broadcast.
    """
    wanted = layouts.select("bank_slug", "header_key", "layout_role").distinct()
    keyed = mapping.join(declared, "file_id", "left").withColumn("header_key", layout_key(F.col("header")))
    matched = keyed.join(F.broadcast(wanted), ["bank_slug", "header_key"], "left")
    resolved = preset_roles(matched, ["file_id"], "col_index", "layout_role")
    preset = F.col("preset_role")
    return resolved.select(
        "file_id",
        "col_index",
        "header",
        F.coalesce(preset, F.col("role")).alias("role"),
        F.when(preset == "ignored", F.lit(0.0)).when(preset.isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        "user_assigned",
    )


def apply_overrides(mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set user-chosen roles, ``(file_id, col_index, role)``, one per file.

    Any other column that held the chosen role becomes ``ignored``.
    """
    chosen = overrides.select("file_id", "col_index", F.col("role").alias("chosen"))
    joined = mapping.join(chosen, ["file_id", "col_index"], "left")
    in_file = F.max("chosen").over(W.partitionBy("file_id"))
    mine = F.col("chosen").isNotNull()
    displaced = ~mine & (F.col("__taken") != "ignored") & (F.col("role") == F.col("__taken"))
    out = joined.withColumn("__taken", in_file)
    return out.select(
        "file_id",
        "col_index",
        "header",
        F.when(mine, F.col("chosen")).when(displaced, F.lit("ignored")).otherwise(F.col("role")).alias("role"),
        F.when(mine, F.lit(1.0)).when(displaced, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(mine | displaced | F.col("user_assigned"), F.col("user_assigned")).alias("user_assigned"),
    )


# --- per file ----------------------------------------------------------------


def roles_by_file(mapping: DataFrame) -> DataFrame:
    """One row per file: ``at.<role>`` is the lowest column index of the role."""
    slots = [r for r in rules.ROLES if r != "ignored"]
    return mapping.groupBy("file_id").agg(
        F.struct(*[F.min(F.when(F.col("role") == r, F.col("col_index"))).alias(r) for r in slots]).alias("at"),
        F.array_sort(F.collect_list(F.struct("col_index", "header", "role", "confidence", "user_assigned"))).alias("columns"),
    )


def amount_convention() -> Column:
    """Over ``at``: how the file writes signs."""
    return (
        F.when(F.col("at.debit").isNotNull() & F.col("at.credit").isNotNull(), "debit-credit")
        .when(F.col("at.amount").isNotNull() & F.col("at.type").isNotNull(), "magnitude-with-indicator")
        .otherwise("signed")
    )


def date_index() -> Column:
    return F.coalesce(F.col("at.date"), F.col("at.postedDate"))


def cell(index: Column) -> Column:
    """A trimmed cell; blank when the role is unmapped or the row is short."""
    return F.coalesce(strip(F.get(F.col("cells"), index)), F.lit(""))


def role_cell(role: str) -> Column:
    return cell(F.col(f"at.{role}"))


def mapping_view(rows: DataFrame, mapping: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Per column: role and first non-blank sample; per file: what is missing."""
    first = (
        column_samples(rows, sample_rows)
        .withColumn("value", strip(F.col("value")))
        .filter(F.col("value") != "")
        .groupBy("file_id", "col_index")
        .agg(F.min_by("value", "source_row").alias("sample"))
    )
    at = roles_by_file(mapping).select(
        "file_id",
        date_index().isNotNull().alias("has_date"),
        F.col("at.description").isNotNull().alias("has_description"),
        (F.col("at.amount").isNotNull() | (F.col("at.debit").isNotNull() & F.col("at.credit").isNotNull())).alias("has_amount"),
        F.when(F.col("at.debit").isNotNull() & F.col("at.credit").isNotNull(), "debit / credit pair")
        .when(F.col("at.amount").isNotNull(), "signed amount")
        .otherwise("unset")
        .alias("convention_label"),
    )
    return mapping.join(first, ["file_id", "col_index"], "left").join(at, "file_id").withColumn("sample", F.coalesce("sample", F.lit("—")))
