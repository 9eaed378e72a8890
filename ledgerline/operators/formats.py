"""How a file writes dates, numbers and currencies, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.dates import preview_order, with_date_parts, with_preview_parts
from ledgerline.functions.text import strip
from ledgerline.operators.columns import amount_convention, cell, date_index


MONEY = ("amount", "debit", "credit", "balance")


def _sampled(rows: DataFrame, roles: DataFrame, sample_rows: int | None) -> DataFrame:
    head = rows if sample_rows is None else rows.filter(F.col("source_row") < sample_rows)
    return head.select("file_id", "source_row", "cells").join(roles.select("file_id", "at"), "file_id", "left")


def infer_dates(samples: DataFrame, value: str = "value") -> DataFrame:
    """Day/month order of each file from ``(file_id, source_row, value)``."""
    parts = with_date_parts(samples, value, "d")
    row, a, b = F.col("source_row"), F.col("d_a"), F.col("d_b")
    hit = F.col("d_is_date")
    alpha, year = F.col("d_alpha_month_at"), F.col("d_year_at")

    def first(column: Column, condition: Column) -> Column:
        return F.min_by(F.when(condition, column), F.when(condition, row))

    facts = parts.groupBy("file_id").agg(
        F.count_if(strip(F.col(value)) != "").alias("total"),
        F.count_if(hit).alias("parsed"),
        first(F.col("d_separator"), F.col("d_separator").isNotNull()).alias("separator"),
        F.coalesce(first(alpha, alpha >= 0), F.lit(-1)).alias("alpha_at"),
        F.coalesce(first(year, year >= 0), F.lit(-1)).alias("year_at"),
        F.coalesce(F.bool_or(F.col("d_time_seconds").isNotNull()), F.lit(False)).alias("has_time"),
        F.coalesce(F.max(a), F.lit(0)).alias("max_a"),
        F.coalesce(F.max(b), F.lit(0)).alias("max_b"),
    )
    year_first = (F.col("year_at") == 0) | (F.col("max_a") > 31)
    forced = year_first | F.col("alpha_at").isin(0, 1) | (F.col("max_a") > 12) | (F.col("max_b") > 12)
    order = (
        F.when(year_first, "YMD")
        .when(F.col("alpha_at") == 1, "DMY")
        .when(F.col("alpha_at") == 0, "MDY")
        .when(F.col("max_a") > 12, "DMY")
        .otherwise("MDY")
    )
    return facts.select(
        "file_id",
        order.alias("date_order"),
        F.col("separator").alias("date_separator"),
        (F.col("year_at") >= 0).alias("four_digit_year"),
        (F.col("alpha_at") >= 0).alias("month_is_alpha"),
        F.col("has_time").alias("date_has_time"),
        F.coalesce(F.try_divide(F.col("parsed"), F.col("total")), F.lit(0.0)).alias("date_confidence"),
        (~forced).alias("date_ambiguous"),
    )


def date_samples(rows: DataFrame, roles: DataFrame, sample_rows: int | None = None) -> DataFrame:
    return _sampled(rows, roles, sample_rows).select("file_id", "source_row", cell(date_index()).alias("value"))


def infer_preview_order(samples: DataFrame, value: str = "value") -> DataFrame:
    """The lighter order used by the quality checks."""
    return with_preview_parts(samples, value, "p").groupBy("file_id").agg(preview_order("p").alias("preview_order"))


def amount_samples(rows: DataFrame, roles: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Every money cell, one row per cell."""
    cells = F.array(*[F.when(F.col(f"at.{r}").isNotNull(), cell(F.col(f"at.{r}"))) for r in MONEY])
    return (
        _sampled(rows, roles, sample_rows)
        .select("file_id", F.explode(cells).alias("value"))
        .filter(F.col("value").isNotNull())
    )


def money_files(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """The files of `amount_samples`: those with rows and a money column."""
    money = F.coalesce(*[F.col(f"at.{r}") for r in MONEY])
    return roles.filter(money.isNotNull()).select("file_id").join(rows.select("file_id"), "file_id", "left_semi")


def currency_marks(value: Column) -> Column:
    """Currency tokens written inside a cell."""
    return F.transform(F.regexp_extract_all(value, F.lit(rules.CURRENCY_MARKS), F.lit(0)), strip)


def infer_numbers(samples: DataFrame) -> DataFrame:
    """Decimal and group separators of each file from ``(file_id, value)``."""
    v = F.col("value")
    bare = F.regexp_replace(F.regexp_replace(v, rules.CURRENCY_MARKS, ""), rules.SIGN_SUFFIX, "")
    step = samples.withColumn("value", strip(v)).filter(v != "").withColumns({"bare": bare, "marks": currency_marks(v)})
    step = step.withColumns(
        {
            "dots": F.regexp_count("bare", F.lit(r"\.")),
            "commas": F.regexp_count("bare", F.lit(",")),
            "last": F.regexp_extract("bare", r"(?s)([.,])[^.,]*$", 1),
        }
    )
    dots, commas, text = F.col("dots"), F.col("commas"), F.col("bare")
    both = (dots > 0) & (commas > 0)

    def saw(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    facts = step.groupBy("file_id").agg(
        F.sum(dots).alias("dot_count"),
        F.sum(commas).alias("comma_count"),
        saw(both).alias("both"),
        saw(F.when(both, F.col("last") == ".").otherwise((dots == 1) & ~text.rlike(r"\.[0-9]{3}(?![0-9])"))).alias("dot_decimal"),
        saw(F.when(both, F.col("last") == ",").otherwise((commas == 1) & ~text.rlike(r",[0-9]{3}(?![0-9])"))).alias("comma_decimal"),
        saw(F.when(both, F.col("last") == ",").otherwise(dots > 1)).alias("dot_group"),
        saw(F.when(both, F.col("last") == ".").otherwise(commas > 1)).alias("comma_group"),
        saw(text.rlike(r"[0-9] [0-9]{3}\b")).alias("space_group"),
        saw(text.rlike(r"[0-9]'[0-9]{3}\b")).alias("apostrophe_group"),
        saw(v.rlike(r"^\(.*\)$")).alias("parentheses_negative"),
        saw(v.rlike(r"[-+]\s*$")).alias("trailing_sign"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("marks")))).alias("stripped_symbols"),
    )
    dot, comma = F.col("dot_decimal"), F.col("comma_decimal")
    evidence = F.col("both") | (dot != comma)
    comma_is_decimal = F.when(evidence, comma & ~dot).otherwise(F.col("dot_group") & ~F.col("comma_group"))
    decided = facts.withColumn("decimal_separator", F.when(comma_is_decimal, ",").otherwise("."))
    group = (
        F.when(F.col("space_group"), " ")
        .when(F.col("apostrophe_group"), "'")
        .when((F.col("decimal_separator") == ".") & (F.col("comma_count") > 0), ",")
        .when((F.col("decimal_separator") == ",") & (F.col("dot_count") > 0), ".")
    )
    return decided.select(
        "file_id", "decimal_separator", group.alias("group_separator"), "parentheses_negative", "trailing_sign", "stripped_symbols"
    )


# --- currencies --------------------------------------------------------------


def _candidate_map() -> Column:
    pairs = []
    for token, codes in rules.CURRENCY_CANDIDATES.items():
        pairs += [F.lit(token), F.array(*[F.lit(c) for c in codes])]
    return F.create_map(*pairs)


def candidates(token: Column) -> Column:
    """ISO codes a currency token may denote."""
    trimmed = strip(token)
    return F.coalesce(F.try_element_at(_candidate_map(), trimmed), F.array(F.upper(trimmed)))


def tokens_conflict(tokens: Column) -> Column:
    """True when no single currency explains every token of a short array."""
    common = F.aggregate(
        F.transform(tokens, candidates),
        F.lit(None).cast("array<string>"),
        lambda kept, codes: F.when(kept.isNull(), codes).otherwise(F.array_intersect(kept, codes)),
    )
    return F.coalesce(F.size(common) == 0, F.lit(False)) & (F.size(tokens) > 0)


def describe_token(token: Column) -> Column:
    primary = F.get(candidates(token), F.lit(0))
    return F.when(primary != F.upper(strip(token)), F.concat(token, F.lit(" ("), primary, F.lit(")"))).otherwise(token)


def sample_collisions(rows: DataFrame, roles: DataFrame, numbers: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Files whose rows mix currencies, one issue row each.

    The currency column is looked at first, then the symbols inside amounts.
    """
    codes = (
        _sampled(rows, roles, sample_rows)
        .filter(F.col("at.currency").isNotNull())
        .select("file_id", F.col("at.currency").alias("currency_column"), cell(F.col("at.currency")).alias("code"))
        .groupBy("file_id", "currency_column")
        .agg(F.array_sort(F.collect_set(F.nullif("code", F.lit("")))).alias("codes"))
    )
    facts = numbers.select("file_id", "stripped_symbols").join(codes, "file_id", "full")
    no_tokens = F.array().cast("array<string>")
    codes_, marks = F.coalesce("codes", no_tokens), F.coalesce("stripped_symbols", no_tokens)
    by_column, by_symbol = tokens_conflict(codes_), tokens_conflict(marks)

    def listed(tokens):
        return F.array_join(F.transform(tokens, describe_token), ", ")

    closing = F.lit("). A single OFX statement can only declare one.")
    message = F.when(
        by_column, F.concat(F.lit("The currency column holds more than one currency ("), listed(codes_), closing)
    ).otherwise(F.concat(F.lit("The amounts mix more than one currency ("), listed(marks), closing))
    return facts.filter(by_column | by_symbol).select(
        "file_id",
        F.lit("error").alias("level"),
        F.lit("multi-currency").alias("code"),
        message.alias("message"),
        F.lit(None).cast("bigint").alias("row"),
        F.when(by_column, F.col("currency_column")).alias("column"),
    )


def currency_conflicts(df: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Groups whose rows mix currencies, over every row.

    Tokens are deduplicated by a shuffled aggregate, then each candidate code is
    counted: a code that explains all tokens of the group clears it.
    """
    tokens = df.select(*keys, token).distinct()
    votes = tokens.select(*keys, F.explode(F.array_distinct(candidates(F.col(token)))).alias("__code")).groupBy(*keys, "__code").count()
    best = votes.groupBy(*keys).agg(F.max("count").alias("explained"))
    totals = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("tokens"), F.array_sort(F.collect_list(token)).alias("currencies"))
    return totals.join(best, keys).select(*keys, "tokens", "currencies", (F.col("explained") < F.col("tokens")).alias("conflict"))


# --- the profile -------------------------------------------------------------


def profile_formats(rows: DataFrame, mapping: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row per file: roles, convention, date and number format, decided by every row."""
    from ledgerline.operators.columns import roles_by_file

    roles = roles_by_file(mapping)
    dates = infer_dates(date_samples(rows, roles, sample_rows))
    numbers = infer_numbers(amount_samples(rows, roles, sample_rows))
    joined = roles.join(dates, "file_id", "left").join(numbers, "file_id", "left")
    return joined.withColumns(
        {
            "convention": amount_convention(),
            "date_order": F.coalesce("date_order", F.lit("MDY")),
            "date_has_time": F.coalesce("date_has_time", F.lit(False)),
            "decimal_separator": F.coalesce("decimal_separator", F.lit(".")),
        }
    )
