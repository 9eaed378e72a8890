"""One row per statement, and the statement documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.dates import render_date, render_datetime
from ledgerline.functions.money import MINOR, render_minor
from ledgerline.functions.text import id_token, markup_text
from ledgerline.operators.identity import statement_uid

CRLF = "\r\n"
ROWS_PER_PART = 20_000


def statement_totals(transactions: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Period, closing balance and end ids per file, in one partial aggregate."""
    row, balance = F.col("source_row"), F.col("balance_minor")
    return transactions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.min("date_posted").alias("first_date"),
        F.max("date_posted").alias("last_date"),
        F.max_by(balance, F.when(balance.isNotNull(), row)).alias("last_balance"),
        F.min_by("fit_id", row).alias("first_fit_id"),
        F.max_by("fit_id", row).alias("last_fit_id"),
        F.min(F.floor(row / rows_per_part)).alias("first_part"),
        F.max(F.floor(row / rows_per_part)).alias("last_part"),
    )


def statements(transactions: DataFrame, accounts: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The statement row of every account file, empty files included.

    ``accounts`` may also carry ``range_start``, ``range_end``, ``as_of_date``,
    ``as_of_seconds``, ``ledger_minor``, ``available_minor`` and ``intuit_bid``
    where a caller knows better than the rows.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in accounts.columns else F.lit(None).cast(kind)

    joined = accounts.join(statement_totals(transactions, rows_per_part), "file_id", "left")
    as_of = F.coalesce(given("as_of_date", "date"), F.col("last_date"), F.to_date(F.lit("1970-01-01")))
    count = F.coalesce("transaction_count", F.lit(0))
    return joined.select(
        *[c for c in ("file_id", "account_id", *rules.ACCOUNT_DEFAULTS)],
        count.cast("bigint").alias("transaction_count"),
        F.coalesce(given("range_start", "date"), F.col("first_date"), as_of).alias("period_start"),
        F.coalesce(given("range_end", "date"), F.col("last_date"), as_of).alias("period_end"),
        as_of.alias("as_of_date"),
        F.coalesce(given("as_of_seconds", "int"), F.lit(0)).alias("as_of_seconds"),
        F.coalesce(given("ledger_minor", MINOR), F.col("last_balance"), F.lit(0)).cast(MINOR).alias("ledger_minor"),
        given("available_minor", MINOR).alias("available_minor"),
        F.coalesce(given("intuit_bid", "string"), F.col("fid")).alias("intuit_bid"),
        statement_uid(F.col("bank_id"), F.col("account_id"), count, F.col("first_fit_id"), F.col("last_fit_id")).alias("uid"),
        F.coalesce("first_part", F.lit(0)).alias("first_part"),
        F.coalesce("last_part", F.lit(0)).alias("last_part"),
    )


# --- documents ---------------------------------------------------------------


def _line(depth: int, text: Column | str) -> Column:
    pad = F.lit("  " * depth)
    return F.concat(pad, F.lit(text) if isinstance(text, str) else text)


def _leaf(depth: int, tag: str, value: Column) -> Column:
    """An open-only leaf, or NULL when there is no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("  " * depth + f"<{tag}>"), value))


def _lines(parts: list[Column]) -> Column:
    return F.concat_ws(CRLF, *parts)


def transaction_leaves() -> dict[str, Column]:
    """Values of the leaves of one transaction, in order; NULL or empty where there is none."""
    caps = rules.TEXT_CAPS
    posted = F.when(F.col("time_seconds").isNull(), render_date(F.col("date_posted"))).otherwise(
        render_datetime(F.col("date_posted"), F.col("time_seconds"), F.lit(""))
    )
    return {
        "TRNTYPE": F.col("type"),
        "DTPOSTED": posted,
        "DTUSER": render_date(F.col("date_user")),
        "TRNAMT": render_minor(F.col("amount_minor"), F.col("scale")),
        "FITID": id_token(F.col("fit_id"), caps["fit_id"]),
        "CHECKNUM": id_token(F.col("check_number"), caps["check_number"]),
        "REFNUM": id_token(F.col("reference_number"), caps["reference_number"]),
        "NAME": markup_text(F.col("name"), caps["name"]),
        "MEMO": markup_text(F.col("memo"), caps["memo"]),
    }


def transaction_blocks(transactions: DataFrame, keep: list[Column], depth: int = 5) -> DataFrame:
    """Columns to keep, and the markup of every transaction in ``block``; absent leaves leave no line.

    The leaves are a projection of their own, so that each is made once however often the markup looks at it.
    """
    inner = depth + 1
    leaves = transactions.select(*keep, *[value.alias(f"__{tag}") for tag, value in transaction_leaves().items()])

    def value(tag: str) -> Column:
        own = F.col(f"__{tag}")
        return F.when(own != "", own).otherwise(F.col("__TRNTYPE")) if tag == "NAME" else own

    lines = [_line(depth, "<STMTTRN>"), *[_leaf(inner, tag, value(tag)) for tag in transaction_leaves()], _line(depth, "</STMTTRN>")]
    return leaves.select(*[c for c in leaves.columns if not c.startswith("__")], _lines(lines).alias("block"))


def _opening(dialect: Column) -> Column:
    caps = rules.TEXT_CAPS
    stamp = render_datetime(F.col("as_of_date"), F.col("as_of_seconds"), F.col("time_zone_suffix"))
    header = [F.lit(f"{k}:{v}") for k, v in rules.DOCUMENT_HEADER]
    currency = F.coalesce(F.nullif(F.upper(id_token(F.col("currency"), caps["currency"])), F.lit("")), F.lit("USD"))
    routing = F.when(dialect != "ofx", id_token(F.col("intuit_bid"), caps["fid"]))
    return _lines(
        [
            *header,
            F.concat(F.lit("NEWFILEUID:"), F.col("uid")),
            F.lit(""),
            _line(0, "<OFX>"),
            _line(1, "<SIGNONMSGSRSV1>"),
            _line(2, "<SONRS>"),
            _line(3, "<STATUS>"),
            _line(4, "<CODE>0"),
            _line(4, "<SEVERITY>INFO"),
            _line(3, "</STATUS>"),
            _leaf(3, "DTSERVER", stamp),
            _leaf(3, "LANGUAGE", F.col("language")),
            _line(3, "<FI>"),
            _leaf(4, "ORG", markup_text(F.col("institution"), caps["institution"])),
            _leaf(4, "FID", id_token(F.col("fid"), caps["fid"])),
            _line(3, "</FI>"),
            _leaf(3, "INTU.BID", routing),
            _line(2, "</SONRS>"),
            _line(1, "</SIGNONMSGSRSV1>"),
            _line(1, "<BANKMSGSRSV1>"),
            _line(2, "<STMTTRNRS>"),
            _line(3, "<TRNUID>1"),
            _line(3, "<STATUS>"),
            _line(4, "<CODE>0"),
            _line(4, "<SEVERITY>INFO"),
            _line(3, "</STATUS>"),
            _line(3, "<STMTRS>"),
            _leaf(4, "CURDEF", currency),
            _line(4, "<BANKACCTFROM>"),
            _leaf(5, "BANKID", id_token(F.col("bank_id"), caps["bank_id"])),
            _leaf(5, "ACCTID", id_token(F.col("account_id"), caps["account_id"])),
            _leaf(5, "ACCTTYPE", F.col("account_type")),
            _line(4, "</BANKACCTFROM>"),
            _line(4, "<BANKTRANLIST>"),
            _leaf(5, "DTSTART", render_date(F.col("period_start"))),
            _leaf(5, "DTEND", render_date(F.col("period_end"))),
        ]
    )


def _closing() -> Column:
    stamp = render_datetime(F.col("as_of_date"), F.col("as_of_seconds"), F.col("time_zone_suffix"))
    available = F.col("available_minor")

    def if_known(text: Column) -> Column:
        return F.when(available.isNotNull(), text)

    return _lines(
        [
            _line(4, "</BANKTRANLIST>"),
            _line(4, "<LEDGERBAL>"),
            _leaf(5, "BALAMT", render_minor(F.col("ledger_minor"), F.col("scale"))),
            _leaf(5, "DTASOF", stamp),
            _line(4, "</LEDGERBAL>"),
            if_known(_line(4, "<AVAILBAL>")),
            if_known(_leaf(5, "BALAMT", render_minor(available, F.col("scale")))),
            if_known(_leaf(5, "DTASOF", stamp)),
            if_known(_line(4, "</AVAILBAL>")),
            _line(3, "</STMTRS>"),
            _line(2, "</STMTTRNRS>"),
            _line(1, "</BANKMSGSRSV1>"),
            _line(0, "</OFX>"),
        ]
    )


def documents(transactions: DataFrame, statement: DataFrame, dialect: str | Column = "ofx", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Statement documents as ordered parts: ``(file_id, dialect, part, parts, text)``.

    A part holds at most `rows_per_part` rows of the source (the same number as
    in `statements`), so collecting one
    is bounded however long the statement is; nearly every statement is a single
    part. The parts of a file joined in order are the document.

    Opening and closing lines meet the transactions in the aggregation that makes
    the parts: texts are shuffled once, and never broadcast or joined.
    """
    dialect = F.lit(dialect) if isinstance(dialect, str) else dialect
    blocks = transaction_blocks(transactions, [F.col("file_id"), F.floor(F.col("source_row") / rows_per_part).alias("part"), F.col("source_row")])
    lines = blocks.select("file_id", "part", F.struct("source_row", "block").alias("line"))
    each = statement.select("*", F.explode(F.sequence("first_part", "last_part")).alias("part"))
    frame = F.struct(
        dialect.alias("dialect"),
        (F.col("last_part") - F.col("first_part") + 1).alias("parts"),
        F.when(F.col("part") == F.col("first_part"), _opening(dialect)).alias("opening"),
        F.when(F.col("part") == F.col("last_part"), _closing()).alias("closing"),
    )
    frames = each.select("file_id", "part", frame.alias("frame"))
    # Lists made before the shuffle would hold few lines each, and cost more than they save.
    dealt = lines.unionByName(frames, allowMissingColumns=True).repartition("file_id", "part")
    made = dealt.groupBy("file_id", "part").agg(
        F.array_sort(F.collect_list("line")).alias("lines"), F.collect_list("frame").alias("frames")
    )
    body = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["block"]), CRLF))
    whole = made.select("file_id", "part", body.alias("body"), F.explode("frames").alias("frame"))
    text = _lines([F.col("frame.opening"), F.col("body"), F.col("frame.closing")])
    # Parts between the ends may have had no row that was accepted.
    shown = whole.filter(F.coalesce("body", "frame.opening", "frame.closing").isNotNull())
    return shown.select("file_id", "frame.dialect", "part", "frame.parts", F.concat(text, F.lit(CRLF)).alias("text"))
