"""Delimiter, header and body of every decoded file.

Input is one row per file with ``text``; all of it is expressions over that
row, so no file is regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.dates import is_date_text
from ledgerline.functions.money import looks_numeric
from ledgerline.functions.records import by_delimiter, head_pattern, record_widths, records
from ledgerline.functions.staged import pin
from ledgerline.functions.text import strip


def line_ending(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit("\r\n")), "\r\n")
        .when(F.contains(text, F.lit("\n")), "\n")
        .when(F.contains(text, F.lit("\r")), "\r")
        .otherwise("\n")
    )


def _widths(text: Column, delimiter: str, sniff_rows: int | None) -> Column:
    """Widths of the non-blank records under one candidate delimiter, or of the first of them.

    NULL where the text does not hold the candidate: one cell a record is no vote.
    """
    if sniff_rows is not None:
        lines = F.regexp_extract(text, head_pattern(delimiter, sniff_rows), 0)
        return F.slice(record_widths(lines, delimiter), 1, sniff_rows)
    return F.when(F.contains(text, F.lit(delimiter)), record_widths(text, delimiter))


def _vote(widths: Column, delimiter: str, order: int) -> Column:
    """Score of a candidate: agreement on the modal width first, then the width."""
    counts = F.transform(
        F.array_distinct(widths),
        lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("hits"), w.alias("width")),
    )
    return modal_vote(F.array_max(counts), F.size(widths), delimiter, order)


def modal_vote(modal: Column, total: Column, delimiter: str, order: int) -> Column:
    """The same from the most frequent width ``(hits, width)`` of ``total`` records."""
    consistency = F.try_divide(modal["hits"], total)
    score = consistency * 100 + F.least(modal["width"], F.lit(40))
    vote = F.struct(
        score.alias("score"), F.lit(-order).alias("rank"), F.lit(delimiter).alias("delimiter"),
        modal["width"].alias("width"), consistency.alias("consistency"),
    )
    return F.when(modal["width"] >= 2, vote)


def detect_delimiter(files: DataFrame, sniff_rows: int | None = None) -> DataFrame:
    """Add ``line_ending``, ``delimiter``, ``field_count`` and ``consistency``.

    All records vote; ``sniff_rows`` lets the first ones only.
    """
    text = F.col("text")
    widths = {f"__w{i}": _widths(text, d, sniff_rows) for i, d in enumerate(rules.DELIMITERS)}
    voted = files.withColumns(widths).withColumns({f"__v{i}": _vote(F.col(f"__w{i}"), d, i) for i, d in enumerate(rules.DELIMITERS)})
    best = F.array_max(F.array(*[F.col(f"__v{i}") for i in range(len(rules.DELIMITERS))]))
    return pin(
        voted.withColumn("__best", best),
        {
            "line_ending": line_ending(text),
            "delimiter": F.coalesce("__best.delimiter", F.lit(rules.DEFAULT_DELIMITER)),
            "field_count": F.coalesce("__best.width", F.lit(1)),
            "consistency": F.coalesce("__best.consistency", F.lit(0.0)),
        },
        drop=("__best", "__w", "__v"),
    )


def header_position(rows: Column, width: Column) -> Column:
    """Index of the header among the records, -1 for a headerless file.

    A header stands before the body, so of the records as wide as the body the
    first ones are judged, however long the preamble above them is.
    """

    placed = F.transform(rows, lambda row, i: F.struct(row.alias("row"), i.alias("i")))
    candidates = F.slice(F.filter(placed, lambda x: F.size(x["row"]) == width), 1, rules.HEADER_CANDIDATES)

    def judge(x: Column) -> Column:
        row, i = x["row"], x["i"]
        filled = F.filter(F.transform(row, strip), lambda c: c != "")
        labels = F.filter(filled, lambda c: ~looks_numeric(c) & ~is_date_text(c))
        return F.struct(i.alias("i"), F.size(row).alias("n"), F.size(filled).alias("filled"), F.size(labels).alias("labels"))

    start = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("i"), F.lit(False).alias("settled"))

    def step(best: Column, x: Column) -> Column:
        enough = (x["n"] == width) & (x["filled"] >= F.greatest(F.lit(2), F.ceil(width * 0.6)))
        score = x["labels"] / x["filled"] + x["filled"] / width / 100
        better = ~best["settled"] & enough & (score > best["score"])
        found = F.struct(score.alias("score"), x["i"].alias("i"), (x["labels"] == x["filled"]).alias("settled"))
        return F.when(better, found).otherwise(best)

    best = F.aggregate(F.transform(candidates, judge), start, step)
    return F.when(best["score"] >= 0.75, best["i"]).otherwise(F.lit(-1))


def lay_out(files: DataFrame, sniff_rows: int | None = None) -> DataFrame:
    """Everything `detect_delimiter` finds, plus header, names and body cells."""
    df = detect_delimiter(files, sniff_rows)
    df = pin(df, {"__all": by_delimiter(F.col("delimiter"), lambda d: records(F.col("text"), d))}, drop=("text",))
    df = pin(df, {"__at": header_position(F.col("__all"), F.col("field_count"))})
    has_header = F.col("__at") >= 0
    named = F.transform(F.get("__all", F.col("__at")), strip)
    numbered = F.transform(F.sequence(F.lit(1), F.col("field_count")), lambda i: F.concat(F.lit("Column "), i))
    # Start after the header; a trailer of another width drops out here.
    tail = F.slice("__all", F.col("__at") + 2, F.greatest(F.size("__all"), F.lit(1)))
    df = df.withColumn("__body", F.filter(tail, lambda row: F.size(row) == F.col("field_count")))
    return pin(
        df,
        {
            "preamble_rows": F.greatest(F.col("__at"), F.lit(0)),
            "has_header": has_header,
            "headers": F.when(has_header, named).otherwise(numbered),
            "row_count": F.size("__body"),
            "body": F.col("__body"),
        },
        drop=("__all", "__at", "__body"),
    )


def body_rows(laid_out: DataFrame) -> DataFrame:
    """``(file_id, source_row, cells)``; the position is dense within the file."""
    return laid_out.select("file_id", F.posexplode("body").alias("source_row", "cells")).withColumn(
        "source_row", F.col("source_row").cast("bigint")
    )


def preview(rows: DataFrame, limit: int = rules.PREVIEW_ROWS) -> DataFrame:
    """The first rows of every file."""
    return rows.filter(F.col("source_row") < limit)


def layout_issues(laid_out: DataFrame) -> DataFrame:
    """File-level findings of the layout, in reporting order (``ordinal``).

    A file without rows gets that one finding only.
    """

    def issue(ordinal: int, condition: Column, level: str, code: str, message: Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(ordinal).alias("ordinal"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message")),
        )

    empty = F.col("row_count") == 0
    headed = F.col("has_header")
    share = F.floor(F.col("consistency") * 100 + 0.5).cast("string")
    none = F.when(headed, "The file has a header row but no transactions.").otherwise("No data rows found.")
    guess = F.concat(
        F.lit("Could not confidently detect the encoding (best guess: "),
        F.coalesce("detected_label", F.lit("none")),
        F.lit("); decoded as Windows-1252."),
    )
    ragged = F.concat(F.lit("Only "), share, F.lit("% of rows have the expected "), F.col("field_count"), F.lit(" columns."))
    found = F.array_compact(
        F.array(
            issue(0, empty, "error", "no-rows", none),
            issue(1, ~empty & F.col("fallback"), "warning", "encoding-fallback", guess),
            issue(2, ~empty & (F.col("consistency") < 0.9), "warning", "ragged-rows", ragged),
            issue(3, ~empty & ~headed, "warning", "no-header", F.lit("No header row found; columns were mapped from their contents.")),
        )
    )
    return laid_out.select("file_id", F.explode(found).alias("x")).select(
        "file_id",
        "x.ordinal",
        "x.level",
        "x.code",
        "x.message",
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast("int").alias("column"),
    )


def column_issues(profile: DataFrame, amount_cells: DataFrame) -> DataFrame:
    """Missing date or amount column, and what the date column looks like.

    ``amount_cells`` lists files that have any money column: ``(file_id)``.
    """
    from ledgerline.operators.columns import date_index

    index = date_index()
    funded = amount_cells.select("file_id", F.lit(True).alias("__funded")).distinct()
    share = F.floor((1 - F.col("date_confidence")) * 100 + 0.5).cast("string")

    def issue(ordinal, condition, level, code, message, column):
        return F.when(
            condition,
            F.struct(
                F.lit(ordinal).alias("ordinal"), F.lit(level).alias("level"), F.lit(code).alias("code"),
                message.alias("message"), column.cast("int").alias("column"),
            ),
        )

    dated = index.isNotNull()
    none = F.lit(None)
    found = F.array_compact(
        F.array(
            issue(4, ~dated, "error", "no-date-column", F.lit("Could not identify a date column."), none),
            issue(
                5, dated & F.col("date_ambiguous"), "warning", "ambiguous-date-order",
                F.lit("No row has a day above 12, so MM/DD and DD/MM cannot be told apart. Assuming MM/DD/YYYY."), index,
            ),
            issue(
                6, dated & ~F.col("date_ambiguous") & (F.col("date_confidence") < 0.95), "warning", "unparsed-dates",
                F.concat(share, F.lit("% of values in the date column are not dates.")), index,
            ),
            issue(7, F.col("__funded").isNull(), "error", "no-amount-column", F.lit("Could not identify an amount column."), none),
        )
    )
    return (
        profile.join(funded, "file_id", "left")
        .select("file_id", F.explode(found).alias("x"))
        .select("file_id", "x.ordinal", "x.level", "x.code", "x.message", F.lit(None).cast("bigint").alias("row"), "x.column")
    )
