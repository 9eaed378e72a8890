"""The quick way of a parser reads a cell as its steps do."""

import random

from pyspark.sql import functions as F

from ledgerline.functions.dates import PREVIEW_PARTS, date_parts, is_date_text, preview_parts
from ledgerline.functions.money import minor_units, preview_number
from ledgerline.functions.staged import parse


def _cells(alphabet, pieces, n, seed):
    rng = random.Random(seed)
    made = ["", " ", "0/1/2024", "31/12/2024", "2024-02-30", "2024-1-5 23:59:60", "2024-01-05 24:00:00", "1/2/2024\n", "20240105", "5 Jan 2024"]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return made + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 10))) for _ in range(n)]


def _both(spark, cells, parser, fields):
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    read = [parse(df, {"p": p}).select("i", "c", *[F.col(f"p_{x}" if x else "p") for x in fields]).collect() for p in (parser, parser._replace(quick=None))]
    return [sorted(rows, key=lambda r: r.i) for rows in read]


def test_dates(spark):
    pieces = ["1", "2", "05", "12", "13", "31", "0", "1999", "2024", "/", "/", "-", "-", ".", " ", ":", "10:20:30", " 10:20:30", "Jan", "2024-01-05", "1/2/2024"]
    cells = _cells("0123/-. :a", pieces, 3000, 1)
    for order in (None, "MDY", "DMY", "YMD", "YDM"):
        parser = date_parts(F.col("c"), F.lit(order) if order else None)
        fields = ["is_date", "time_seconds", *(["date"] if order else ["a", "b", "c", "separator", "alpha_month_at", "year_at"])]
        quick, slow = _both(spark, cells, parser, fields)
        assert quick == slow


def test_whether_a_text_is_a_date(spark):
    pieces = ["1", "2", "05", "012", "00", "31", "0", "1999", "2024", "/", "-", ".", ",", " ", "  ", "\u00a0", "10:20", "Jan", "january", "x", "20240105"]
    cells = _cells("0123/-. :aJn,", pieces, 3000, 2)
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    read = parse(df, {"p": date_parts(F.col("c"))._replace(quick=None)}).select("c", "p_is_date", is_date_text(F.col("c")).alias("predicate")).collect()
    assert [r for r in read if r.p_is_date != r.predicate] == []


def test_money(spark):
    pieces = ["1", "12", "234", ",", ".", "50", "-", "(", ")", "$", "USD ", " ", "DR", " CR", "+", "'", "1,234.56", "1.234,56"]
    cells = _cells("0123,.-()$ ", pieces, 3000, 3)
    for point, comma, scale in ((".", ",", 2), (",", ".", 2), (".", None, 2), (".", ",", 0)):
        parser = minor_units(F.col("c"), F.lit(point), F.lit(comma).cast("string"), F.lit(scale))
        quick, slow = _both(spark, cells, parser, [""])
        assert quick == slow


def _not_quick(spark, cells, parser):
    """The cells the quick way leaves to the steps."""
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for step in parser.quick.steps:
        df = df.withColumns(step(F.col))
    return [r.c for r in df.filter(~F.coalesce(parser.quick.ready(F.col), F.lit(False))).select("c").collect()]


def test_preview_dates(spark):
    pieces = ["1", "2", "05", "12", "13", "31", "0", "1999", "2024", "/", "/", "-", "-", ".", " ", ":", "10:20:30", " 10:20:30", "Jan", "2024-01-05", "1/2/2024", "T"]
    cells = [*_cells("0123/-. :aT", pieces, 3000, 4), None]
    quick, slow = _both(spark, cells, preview_parts(F.col("c")), PREVIEW_PARTS)
    assert quick == slow
    assert _not_quick(spark, ["", "1/31/2024", "31/01/2024", "2024-01-05 10:20:30", "0/0/0000"], preview_parts(F.col("c"))) == []


def test_preview_numbers(spark):
    pieces = ["1", "12", "234", ",", ".", "50", "-", "(", ")", "$", "USD ", " ", "DR", " CR", "+", "'", "1,234.56", "1.234,56", "1234.50"]
    cells = [*_cells("0123,.-()$ ", pieces, 4000, 5), None, "€ 1,50", "-£2.00", "1.00\n", "123456789012345.67", "999,999,999,999,999.99"]
    quick, slow = _both(spark, cells, preview_number(F.col("c")), ["", "ambiguous"])
    assert quick == slow
    written = ["", "1,234.56", "-1.234,56", "($1,234.56)", "$12.00", "1234.56", "12.00-", "12.00 DR", "USD 1,234.56", "(-12.00)", "+ 1,234.56 CR", "-0,01"]
    assert _not_quick(spark, written, preview_number(F.col("c"))) == []
