"""Data-quality checks: one row per file and check, and a verdict per file.

All row checks share one pass. Rows are sliced by position, so the comparison
with the previous row and the first offenders are found inside bounded slices,
whatever the size of the file; the slices are then folded per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.dates import preview_ordinal, preview_parts
from ledgerline.functions.money import preview_number
from ledgerline.functions.staged import parse, pin
from ledgerline.operators.columns import cell, date_index, roles_by_file
from ledgerline.operators.issues import fold_issues
from ledgerline.operators.skew import first_rows, merge_first, with_previous
from ledgerline.session import staged

LISTED = 3
CHECKS = [
    "coverage", "empty", "mapping", "date-parse", "date-sequence", "amount-parse",
    "debit-credit", "balance-continuity", "duplicates", "reference-unique", "descriptions",
]
VALUE = "decimal(38,6)"


def plural(count: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(count, 0), F.when(count == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def listed(rows: Column, total: Column) -> Column:
    """``line 4, line 9, line 12, +7 more``; data row 0 is line 2 of the file."""
    shown = F.transform(rows, lambda r: F.concat(F.lit("line "), (r + 2).cast("string")))
    rest = total - F.size(rows)
    more = F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"), F.lit(" more")))
    return F.concat_ws(", ", F.array_join(shown, ", "), more)


def read_rows(rows: DataFrame, mapping: DataFrame, sample_rows: int | None) -> DataFrame:
    """Checked rows with the cells the checks look at, read the light way."""
    body = rows if sample_rows is None else rows.filter(F.col("source_row") < sample_rows)
    joined = body.select("file_id", "source_row", "cells").join(roles_by_file(mapping).select("file_id", "at"), "file_id", "left")
    pair = F.col("at.debit").isNotNull() & F.col("at.credit").isNotNull()
    picked = joined.select(
        "file_id",
        "source_row",
        date_index().isNotNull().alias("has_date"),
        F.col("at.description").isNotNull().alias("has_description"),
        F.col("at.amount").isNotNull().alias("single"),
        pair.alias("pair"),
        F.col("at.balance").isNotNull().alias("has_balance"),
        F.col("at.referenceNumber").isNotNull().alias("has_reference"),
        cell(date_index()).alias("date_cell"),
        cell(F.col("at.description")).alias("description"),
        cell(F.col("at.amount")).alias("amount_cell"),
        cell(F.col("at.debit")).alias("debit_cell"),
        cell(F.col("at.credit")).alias("credit_cell"),
        cell(F.col("at.balance")).alias("balance_cell"),
        cell(F.col("at.referenceNumber")).alias("reference"),
    )
    read = parse(
        picked,
        {
            "d": preview_parts(F.col("date_cell")),
            "amount": preview_number(F.col("amount_cell")),
            "debit": preview_number(F.col("debit_cell")),
            "credit": preview_number(F.col("credit_cell")),
            "balance": preview_number(F.col("balance_cell")),
        },
    )
    debit, credit = F.col("debit"), F.col("credit")
    zero = F.lit(0).cast(VALUE)
    net = (F.coalesce(credit, zero) - F.abs(F.coalesce(debit, zero))).cast(VALUE)
    neither = debit.isNull() & credit.isNull()
    by_pair = ~F.col("single") & F.col("pair")
    return read.withColumns(
        {
            "signed": F.when(F.col("single"), F.col("amount")).when(by_pair & ~neither, net),
            "bad_amount": F.when(F.col("single"), F.col("amount").isNull())
            .when(by_pair, neither & ((F.col("debit_cell") != "") | (F.col("credit_cell") != "")))
            .otherwise(False),
            "ambiguous": F.when(F.col("single"), F.col("amount_ambiguous"))
            .when(by_pair, F.col("debit_ambiguous") | F.col("credit_ambiguous"))
            .otherwise(False),
            "both_filled": F.col("pair") & debit.isNotNull() & credit.isNotNull(),
            "sure_balance": F.when(~F.col("balance_ambiguous"), F.col("balance")),
        }
    )


def _sequence_facts(read: DataFrame) -> DataFrame:
    """Per file: counts and first offenders of the checks that need row order."""
    # Both readings are carried, as the order of the file is known only at the end.
    orders = {o.lower(): preview_ordinal("d", F.lit(o)) for o in ("ISO", "DMY", "MDY")}
    marked = pin(read, {f"ord_{name}": expr for name, expr in orders.items()})
    shifted = with_previous(
        marked, ["file_id"], "source_row", {"prev_balance": "sure_balance"} | {f"prev_{n}": f"ord_{n}" for n in orders}
    )
    row = F.col("source_row")
    # Cents, rounded half up as a running balance is compared to the cent.
    step = F.floor((F.col("sure_balance") - F.col("prev_balance")) * 100 + F.lit("0.5").cast(VALUE))
    amount = F.floor(F.col("signed") * 100 + F.lit("0.5").cast(VALUE))
    flags = {
        "bad_date": ~F.col("d_looks"),
        "bad_amount": F.col("bad_amount"),
        "both_filled": F.col("both_filled"),
        "break": (row > 0) & (step != amount),
        "blank_description": F.col("description") == "",
    }
    for name in orders:
        flags[f"up_{name}"] = F.col(f"ord_{name}") > F.col(f"prev_{name}")
        flags[f"down_{name}"] = F.col(f"ord_{name}") < F.col(f"prev_{name}")
    # The shuffle above already groups by file and slice: this first level is local.
    sliced = shifted.groupBy("file_id", "__slice").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if("d_looks").alias("seen"),
        F.count_if("d_iso").alias("iso"),
        F.count_if(F.col("d_alpha") | (F.col("d_looks") & ~F.col("d_iso") & ~F.col("d_alpha") & (F.col("d_a") > 12) & (F.col("d_b") <= 12))).alias("dmy"),
        F.count_if(F.col("d_looks") & ~F.col("d_iso") & ~F.col("d_alpha") & (F.col("d_b") > 12) & (F.col("d_a") <= 12)).alias("mdy"),
        F.bool_or("ambiguous").alias("any_ambiguous"),
        F.bool_or(F.col("sure_balance").isNull()).alias("any_unsure"),
        F.count_if(F.col("reference") == "").alias("blank_references"),
        *[F.count_if(cond).alias(f"n_{name}") for name, cond in flags.items()],
        *[first_rows(cond, row, LISTED).alias(f"r_{name}") for name, cond in flags.items()],
    )
    facts = sliced.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in ("checked", "seen", "iso", "dmy", "mdy", "blank_references")],
        F.bool_or("any_ambiguous").alias("any_ambiguous"),
        F.bool_or("any_unsure").alias("any_unsure"),
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in flags],
        *[merge_first(f"r_{name}", LISTED).alias(f"r_{name}") for name in flags],
    )
    order = (
        F.when(F.col("seen") == 0, "UNKNOWN")
        .when(F.col("iso") == F.col("seen"), "ISO")
        .when((F.col("dmy") > 0) & (F.col("mdy") > 0), "UNKNOWN")
        .when(F.col("dmy") > 0, "DMY")
        .when(F.col("mdy") > 0, "MDY")
        .otherwise("AMBIGUOUS")
    )
    facts = facts.withColumn("preview_order", order)

    def chosen(prefix: str, direction: str) -> Column:
        expr = F
        for o in ("ISO", "DMY", "MDY"):
            expr = expr.when(F.col("preview_order") == o, F.col(f"{prefix}_{direction}_{o.lower()}"))
        return expr

    ascending = chosen("n", "up") >= chosen("n", "down")
    return facts.withColumns(
        {
            "n_out_of_order": F.when(ascending, chosen("n", "down")).otherwise(chosen("n", "up")),
            "r_out_of_order": F.when(ascending, chosen("r", "down")).otherwise(chosen("r", "up")),
        }
    )


def _duplicate_facts(read: DataFrame) -> DataFrame:
    groups = (
        read.groupBy("file_id", "date_cell", F.lower("description").alias("text"), F.col("signed").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return groups.groupBy("file_id").agg(F.sum("n").alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"))


def _reference_facts(read: DataFrame) -> DataFrame:
    used = read.filter(F.col("has_reference") & (F.col("reference") != "")).groupBy("file_id", "reference").agg(F.count(F.lit(1)).alias("n"))
    return used.groupBy("file_id").agg(F.sum(F.col("n") - 1).alias("repeated_references"))


def row_facts(rows: DataFrame, mapping: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Everything the checks need, one row per file with checked rows.

    The rows are read once and staged, as three aggregations start from them.
    """
    read = staged(read_rows(rows, mapping, sample_rows), "checked")
    out = _sequence_facts(read)
    for side in (_duplicate_facts(read), _reference_facts(read)):
        out = out.join(side, "file_id", "left")
    return out


def quality_checks(rows: DataFrame, mapping: DataFrame, totals: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """The checks of every file in ``totals`` ``(file_id, total_rows)``.

    ``sample_rows=None`` checks whole files; a number checks that many rows and
    says so.
    """
    at = roles_by_file(mapping).select("file_id", "at")
    f = totals.join(at, "file_id", "left").join(row_facts(rows, mapping, sample_rows), "file_id", "left")
    counts = ["checked", "blank_references", "duplicate_rows", "duplicate_groups", "repeated_references", "n_bad_date", "n_bad_amount", "n_both_filled", "n_break", "n_blank_description"]
    no_rows = F.array().cast("array<bigint>")
    f = f.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
        | {c: F.coalesce(c, no_rows) for c in ("r_bad_date", "r_bad_amount", "r_both_filled", "r_break", "r_blank_description", "r_out_of_order")}
        | {
            "has_date": date_index().isNotNull(),
            "has_description": F.col("at.description").isNotNull(),
            "pair": F.col("at.debit").isNotNull() & F.col("at.credit").isNotNull(),
            "single": F.col("at.amount").isNotNull(),
            "preview_order": F.coalesce("preview_order", F.lit("UNKNOWN")),
        }
    )
    checked, total = F.col("checked"), F.col("total_rows")
    has_date, has_amount, pair = F.col("has_date"), F.col("single") | F.col("pair"), F.col("pair")
    order = F.col("preview_order")

    def n(name: str) -> Column:
        return F.col(f"n_{name}")

    def lines(name: str) -> Column:
        return listed(F.col(f"r_{name}"), n(name))

    missing = F.array_compact(
        F.array(
            F.when(~has_date, "Date (or Posted date)"),
            F.when(~F.col("has_description"), "Description"),
            F.when(~has_amount, "Amount (or a Debit/Credit pair)"),
        )
    )
    unordered = order.isin("AMBIGUOUS", "UNKNOWN")
    ambiguous, unsure = F.coalesce("any_ambiguous", F.lit(False)), F.coalesce("any_unsure", F.lit(False))
    sure = ~ambiguous & ~unsure
    no_mapping = F.lit("No Date or Posted date column mapped yet.")

    checks: list[tuple[str, str, Column, Column, Column]] = []

    def add(check: str, label: str, when: Column, status: Column, detail: Column) -> None:
        checks.append((check, label, when, status, detail))

    always = F.lit(True)
    sampled = checked < total
    add(
        "coverage", "Checked rows", always, F.when(sampled, "skip").otherwise("pass"),
        F.when(sampled, F.concat(F.lit("Checks above cover the first "), F.format_number(checked, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" rows. The remainder is verified during conversion.")))
        .otherwise(F.concat(F.lit("Checks above cover all "), plural(total, "row", "rows"), F.lit(" in the file."))),
    )
    add("empty", "File has rows", total == 0, F.lit("fail"), F.lit("The file has a header but no transaction rows underneath it."))
    add(
        "mapping", "Required fields mapped", always, F.when(F.size(missing) == 0, "pass").otherwise("fail"),
        F.when(F.size(missing) > 0, F.concat(F.lit("Still unmapped: "), F.array_join(missing, ", "), F.lit(".")))
        .when(pair & ~F.col("single"), "Date, Description and a Debit/Credit pair are mapped.")
        .otherwise("Date, Description and Amount are all mapped."),
    )
    add(
        "date-parse", "Dates readable", always,
        F.when(~has_date, "skip").when(n("bad_date") == 0, "pass").when(n("bad_date") == checked, "fail").otherwise("warn"),
        F.when(~has_date, no_mapping)
        .when((n("bad_date") == 0) & (order == "AMBIGUOUS"), "Every value is a date, but day/month order is ambiguous — the worker settles it.")
        .when(n("bad_date") == 0, F.concat(F.lit("Every value parses as a date ("), F.when(order == "UNKNOWN", "mixed order").otherwise(order), F.lit(" format).")))
        .otherwise(F.concat(plural(n("bad_date"), "value does", "values do"), F.lit(" not look like a date ("), lines("bad_date"), F.lit(")."))),
    )
    add(
        "date-sequence", "Date sequence", always,
        F.when(~has_date | unordered | (checked == 0), "skip").when(n("out_of_order") == 0, "pass").otherwise("warn"),
        F.when(~has_date, no_mapping)
        .when(unordered | (checked == 0), "Day/month order is ambiguous, so ordering was not verified here.")
        .when(n("out_of_order") == 0, "Dates run in a consistent direction with no breaks.")
        .otherwise(F.concat(plural(n("out_of_order"), "row breaks", "rows break"), F.lit(" the date order ("), lines("out_of_order"), F.lit(")."))),
    )
    add(
        "amount-parse", "Amounts numeric", always,
        F.when(~has_amount, "skip").when((n("bad_amount") == 0) & ambiguous, "warn").when(n("bad_amount") == 0, "pass").when(n("bad_amount") == checked, "fail").otherwise("warn"),
        F.when(~has_amount, "No Amount or Debit/Credit pair mapped yet.")
        .when(n("bad_amount") > 0, F.concat(plural(n("bad_amount"), "row has", "rows have"), F.lit(" an amount that is not a number ("), lines("bad_amount"), F.lit(").")))
        .when(ambiguous, 'All amounts are numeric, but a separator like "1,234" could be thousands or decimals.')
        .otherwise(F.concat(F.lit("All "), plural(checked, "amount reads", "amounts read"), F.lit(" cleanly."))),
    )
    add(
        "debit-credit", "Debit/Credit pairing", pair, F.when(n("both_filled") == 0, "pass").otherwise("warn"),
        F.when(n("both_filled") == 0, "Each row uses either the debit or the credit column, never both.")
        .otherwise(F.concat(plural(n("both_filled"), "row fills", "rows fill"), F.lit(" both debit and credit ("), lines("both_filled"), F.lit(")."))),
    )
    add(
        "balance-continuity", "Balance continuity", F.col("at.balance").isNotNull() & has_amount,
        F.when(~sure, "skip").when(n("break") == 0, "pass").otherwise("warn"),
        F.when(~sure, "Balance column could not be read unambiguously, so continuity was not verified.")
        .when(n("break") == 0, "Every running balance matches the previous balance plus the row amount.")
        .otherwise(F.concat(plural(n("break"), "row does", "rows do"), F.lit(" not reconcile with the running balance ("), lines("break"), F.lit(")."))),
    )
    groups = F.col("duplicate_groups")
    comparable = has_date & has_amount
    add(
        "duplicates", "Unique transactions", always,
        F.when(~comparable, "skip").when(groups == 0, "pass").otherwise("warn"),
        F.when(~comparable, "Needs Date and Amount mapped before duplicates can be found.")
        .when(groups == 0, "No two rows share a date, description and amount.")
        .otherwise(F.concat(plural(F.col("duplicate_rows"), "row repeats", "rows repeat"), F.lit(" another row exactly ("), plural(groups, "group", "groups"), F.lit("). Banks do sometimes bill twice — review before removing."))),
    )
    repeats, blanks = F.col("repeated_references"), F.col("blank_references")
    add(
        "reference-unique", "Reference IDs unique", F.col("at.referenceNumber").isNotNull(),
        F.when((repeats > 0) | (blanks > 0), "warn").otherwise("pass"),
        F.when(repeats > 0, F.concat(plural(repeats, "reference is", "references are"), F.lit(" reused. Duplicate IDs collide when the transaction id is derived.")))
        .when(blanks > 0, F.concat(plural(blanks, "row has", "rows have"), F.lit(" no reference; an id will be derived from the row contents instead.")))
        .otherwise("Every row carries a distinct reference id."),
    )
    described = F.col("has_description")
    add(
        "descriptions", "Descriptions present", always,
        F.when(~described, "skip").when(n("blank_description") == 0, "pass").otherwise("warn"),
        F.when(~described, "No Description column mapped yet.")
        .when(n("blank_description") == 0, "Every row has a description to carry into the NAME field.")
        .otherwise(F.concat(plural(n("blank_description"), "row is", "rows are"), F.lit(" missing a description ("), lines("blank_description"), F.lit("); a placeholder is used."))),
    )

    made = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(i).alias("ordinal"), F.lit(check).alias("check_id"), F.lit(label).alias("label"), status.alias("status"), detail.alias("detail")))
                for i, (check, label, when, status, detail) in enumerate(checks)
            ]
        )
    )
    return f.select("file_id", F.explode(made).alias("x")).select("file_id", F.col("x.ordinal").cast("bigint").alias("ordinal"), "x.check_id", "x.label", "x.status", "x.detail")


def quality_report(checks: DataFrame, totals: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Failures, warnings and readiness per file, worker issues included."""
    everything = checks.select("file_id", "status")
    if issues is not None:
        everything = everything.unionByName(fold_issues(issues).select("file_id", "status"))
    counted = everything.groupBy("file_id").agg(
        F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "warn").alias("warnings")
    )
    failures = F.coalesce("failures", F.lit(0))
    return totals.join(counted, "file_id", "left").select(
        "file_id",
        failures.alias("failures"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        ((failures == 0) & (F.col("total_rows") > 0)).alias("ready"),
    )
