"""Reading and rendering exact money; no floating point touches an amount."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.staged import Parser, Quick, parse
from ledgerline.functions.text import BLANKS, strip

MINOR = "decimal(38,0)"
_CENT = Decimal("0.01")
_MARK = "\u0001"


def looks_numeric(value: Column) -> Column:
    return strip(value).rlike(rules.NUMERIC_CELL)


def grouping_is_wellformed(text: Column, separator: Column) -> Column:
    """Every separator sits between a digit and exactly three digits.

    The separator differs from row to row, so it is first replaced by a marker;
    that keeps the pattern constant and compiled once.
    """
    marked = F.replace(text, separator, F.lit(_MARK))
    return ~marked.rlike(rf"(?<![0-9]){_MARK}|{_MARK}(?![0-9]{{3}}(?![0-9]))")


_CODE = "(?:USD|EUR|GBP|INR|JPY|AUD|CAD|CHF|SGD|AED)"


def _common_minor(cell: Column, decimal_separator: Column, group_separator: Column, scale: Column) -> Column:
    """Minor units of a cell of a common shape with two decimals, as a long; NULL for any other shape.

    Such a cell is ``-1,234.56``, or that number with spaces around it, with a
    currency sign or code beside it, in parentheses, signed before or behind, or
    followed by DR or CR. Whatever it is, the digits give the amount, and
    parentheses, minus signs and DR turn the sign once each.
    """

    def common(point: str, comma: str) -> Column:
        number = rf"(?:[0-9]{{1,15}}|[0-9]{{1,3}}(?:[{comma}][0-9]{{3}}){{1,4}})[{point}][0-9]{{2}}"
        front = rf"(?:[-+]? *(?:[$€£¥] *)?|(?:[-+] +)?{_CODE} +)"
        shape = rf"^ *(?:\( *{front}{number} *\)|{front}{number}(?: +{_CODE}| ?[-+]?(?: +(?:DR|CR))?)) *$"
        grouped = ~F.contains(cell, F.lit(comma)) | F.coalesce(group_separator == comma, F.lit(False))
        plain = F.translate(cell, ".,", "").try_cast("bigint")
        minuses = F.length(cell) - F.length(F.translate(cell, "-", ""))
        turned = (F.contains(cell, F.lit("(")) | F.contains(cell, F.lit("DR"))) != (minuses % 2 == 1)
        amount = F.regexp_replace(cell, "[^0-9]", "").try_cast("bigint")
        dressed = F.when(cell.rlike(shape) & grouped, F.when(turned, -amount).otherwise(amount))
        return F.when(cell.rlike(rf"^-?{number}$") & grouped, plain).otherwise(dressed)

    return F.when((scale == 2) & (cell != ""), F.when(decimal_separator == ",", common(",", ".")).otherwise(common(".", ",")))


def minor_units(cell: Column, decimal_separator: Column, group_separator: Column, scale: Column) -> Parser:
    """Parser of a money cell into signed minor units.

    Blank and unreadable cells are NULL, which is not zero. ``group_separator``
    may be NULL. Blank cells and those of the common shape are read at once.
    """

    quick = Quick(
        [lambda v: {"fast": _common_minor(cell, decimal_separator, group_separator, scale)}],
        lambda v: v("fast").isNotNull() | (cell == ""),
        lambda v: {"": v("fast").cast(MINOR)},
    )

    def outer(v):
        return {"t": strip(cell)}

    def parentheses(v):
        wrapped = F.startswith(v("t"), F.lit("(")) & F.endswith(v("t"), F.lit(")")) & (F.length(v("t")) > 1)
        return {"par": wrapped, "u": F.when(wrapped, strip(F.substring(v("t"), F.lit(2), F.length(v("t")) - 2))).otherwise(v("t"))}

    def suffix(v):
        # Most cells are digits and separators only; the patterns skip those.
        worded = v("u").rlike("[^0-9.,'+ -]")
        bare = strip(F.regexp_replace(strip(F.regexp_replace(v("u"), rules.SIGN_SUFFIX, "")), rules.CURRENCY_MARKS, ""))
        marker = F.when(worded, F.upper(F.regexp_extract(v("u"), rules.SIGN_SUFFIX, 1)))
        return {
            "neg0": v("par") | F.coalesce(marker.isin(rules.DEBIT_MARKERS), F.lit(False)),
            "w": F.when(worded, bare).otherwise(v("u")),
        }

    def leading(v):
        sign = F.substring(v("w"), 1, 1)
        rest = strip(F.substring(v("w"), F.lit(2), F.length(v("w"))))
        return {"minus1": sign == "-", "x": F.when(sign.isin("-", "+"), rest).otherwise(v("w"))}

    def trailing(v):
        sign = F.right(v("x"), F.lit(1))
        rest = strip(F.substring(v("x"), F.lit(1), F.length(v("x")) - 1))
        return {"minus2": sign == "-", "y": F.when(sign.isin("-", "+"), rest).otherwise(v("x"))}

    def ungroup(v):
        grouped = group_separator.isNotNull()
        separator = F.coalesce(group_separator, F.lit(_MARK))
        return {
            "grp": ~F.contains(v("y"), separator) | grouping_is_wellformed(v("y"), separator),
            "z": F.when(grouped, F.replace(v("y"), group_separator, F.lit(""))).otherwise(v("y")),
        }

    def decimal_mark(v):
        solid = F.when(v("z").rlike("[^0-9.,]"), F.translate(v("z"), BLANKS, "")).otherwise(v("z"))
        return {"d": F.when(decimal_separator == ",", F.translate(solid, ",.", ".")).otherwise(F.translate(solid, ",", ""))}

    def parts(v):
        dot = F.instr(v("d"), ".")
        readable = (v("t") != "") & v("grp") & v("d").rlike(r"^[0-9]*\.?[0-9]*$") & ~v("d").isin("", ".")
        whole = F.when(dot > 0, F.substring(v("d"), F.lit(1), dot - 1)).otherwise(v("d"))
        fraction = F.when(dot > 0, F.substring(v("d"), dot + 1, F.length(v("d")))).otherwise(F.lit(""))
        return {"ok": readable, "whole": whole, "frac": F.rpad(fraction, scale + 1, F.lit("0"))}

    def digits(v):
        text = F.concat(F.lit("0"), v("whole"), F.left(v("frac"), scale))
        carry = F.when(F.substring(v("frac"), scale + 1, F.lit(1)) >= "5", F.lit(1)).otherwise(F.lit(0))
        # Up to 17 digits fit a long, which is far cheaper to read.
        short = (text.try_cast("bigint") + carry).cast(MINOR)
        long = F.try_add(text.try_cast(MINOR), carry.cast(MINOR)).cast(MINOR)
        return {"mag": F.when(v("ok"), F.when(F.length(text) <= 17, short).otherwise(long))}

    def signed(v):
        return {"": F.when(v("neg0") != (v("minus1") != v("minus2")), -v("mag")).otherwise(v("mag")).cast(MINOR)}

    return Parser([outer, parentheses, suffix, leading, trailing, ungroup, decimal_mark, parts, digits], signed, quick)


def with_minor_units(
    df: DataFrame, cells: dict[str, str], decimal_separator: Column, group_separator: Column, scale: Column
) -> DataFrame:
    """`minor_units` of several text columns; ``cells`` maps output to input."""
    return parse(df, {out: minor_units(F.col(raw), decimal_separator, group_separator, scale) for out, raw in cells.items()})


def preview_number(cell: Column) -> Parser:
    """Parser of the lighter reader: the value as DECIMAL(38,6), and ``ambiguous``.

    It knows no file format, so a lone separator before three digits is read as
    grouping and flagged.
    """

    def outer(v):
        return {"t": strip(cell)}

    def bare(v):
        wrapped = F.startswith(v("t"), F.lit("(")) & F.endswith(v("t"), F.lit(")")) & (F.length(v("t")) > 1)
        inner = F.when(wrapped, F.substring(v("t"), F.lit(2), F.length(v("t")) - 2)).otherwise(v("t"))
        return {"par": wrapped, "inner": inner}

    def unmarked(v):
        worded = v("inner").rlike("[^0-9.,'+ -]")
        text = F.when(worded, F.regexp_replace(v("inner"), rules.PREVIEW_MARKS, "")).otherwise(v("inner"))
        return {"u": F.translate(text, BLANKS, "")}

    def trailing(v):
        sign = F.right(v("u"), F.lit(1))
        rest = F.substring(v("u"), F.lit(1), F.length(v("u")) - 1)
        return {"m2": sign == "-", "w": F.when(sign.isin("-", "+"), rest).otherwise(v("u"))}

    def leading(v):
        sign = F.substring(v("w"), 1, 1)
        rest = F.substring(v("w"), F.lit(2), F.length(v("w")))
        return {"m1": sign == "-", "x": F.when(sign.isin("-", "+"), rest).otherwise(v("w"))}

    def suffix(v):
        mark = F.lower(F.right(v("x"), F.lit(2)))
        rest = F.substring(v("x"), F.lit(1), F.length(v("x")) - 2)
        return {"dr": mark == "dr", "y": F.when(mark.isin("dr", "cr"), rest).otherwise(v("x"))}

    def shape(v):
        clean = F.translate(v("y"), "'", "")
        return {
            "num": (v("t") != "") & (F.translate(v("y"), "0123456789.,'", "") == "") & (F.translate(v("y"), ".,'", "") != ""),
            "c": clean,
            "dots": F.length(clean) - F.length(F.translate(clean, ".", "")),
            "commas": F.length(clean) - F.length(F.translate(clean, ",", "")),
            # The part after the last separator of either kind.
            "tail": F.length(F.substring_index(F.translate(clean, ",", "."), ".", -1)),
        }

    def number(v):
        both = (v("dots") > 0) & (v("commas") > 0)
        last = F.substring(v("c"), F.length(v("c")) - v("tail"), F.lit(1))
        count = v("dots") + v("commas")
        lone_group = (count > 1) | (v("tail") == 3)
        dot_last = F.translate(v("c"), ",", "")
        comma_last = F.translate(v("c"), ",.", ".")
        text = (
            F.when(count == 0, v("c"))
            .when(both, F.when(last == ".", dot_last).otherwise(comma_last))
            .when(lone_group, F.translate(v("c"), ".,", ""))
            .otherwise(F.translate(v("c"), ",", "."))
        )
        return {
            "val": F.when(v("num"), text.try_cast("decimal(38,6)")),
            "amb": v("num") & ~both & (count == 1) & (v("tail") == 3),
        }

    def result(v):
        # Each of the four marks flips the sign once.
        odd = (v("par").cast("int") + v("m1").cast("int") + v("m2").cast("int") + v("dr").cast("int")) % 2 == 1
        value = F.when(odd, -v("val")).otherwise(v("val")).cast("decimal(38,6)")
        return {"": value, "ambiguous": F.coalesce(v("amb") & v("val").isNotNull(), F.lit(False))}

    return Parser([outer, bare, unmarked, trailing, leading, suffix, shape, number], result, _usual_preview(cell))


# Two decimals behind either mark, grouped by the other one or not at all: then the marks leave no doubt.
_TWO_DECIMALS = r"(?:[0-9]{1,15}[.,]|[0-9]{1,3}(?:(?:,[0-9]{3}){1,4}[.]|(?:[.][0-9]{3}){1,4},))[0-9]{2}"
_FRONT = r"(?:[-+]? *(?:[$€£] *)?|(?:[-+] +)?USD +)"
_USUAL_PREVIEW = rf"\A *(?:-?{_TWO_DECIMALS}|\( *{_FRONT}{_TWO_DECIMALS} *\)|{_FRONT}{_TWO_DECIMALS}(?: *[-+]| +(?:DR|CR))?) *\z"


def _usual_preview(cell: Column) -> Quick:
    """The quick way of `preview_number`: blank cells, and numbers with two decimals as `_common_minor` knows them.

    The digits give the amount; parentheses, minus signs and DR turn the sign once each.
    """

    def shape(v):
        return {"usual": cell.rlike(_USUAL_PREVIEW)}

    def digits(v):
        bare = F.translate(cell, ".,-", "")
        # Few cells hold more than digits, marks and a minus sign.
        dressed = F.translate(bare, " ()+$€£USDRC", "")
        read = F.when(v("usual"), F.coalesce(bare.try_cast("bigint"), dressed.try_cast("bigint")))
        minuses = F.length(cell) - F.length(F.translate(cell, "-", ""))
        return {"digits": read, "turned": (F.contains(cell, F.lit("(")) | F.contains(cell, F.lit("DR"))) != (minuses % 2 == 1)}

    def fields(v):
        value = F.when(v("turned"), -v("digits")).otherwise(v("digits")).cast("decimal(20,0)") * F.lit(_CENT)
        return {"": value.cast("decimal(38,6)"), "ambiguous": F.lit(False)}

    return Quick([shape, digits], lambda v: (cell == "") | v("digits").isNotNull(), fields)


def with_preview_number(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """`preview_number` of several columns as ``{out}`` and ``{out}_ambiguous``."""
    return parse(df, {out: preview_number(F.col(raw)) for out, raw in cells.items()})


def render_minor(minor: Column, scale: Column | int) -> Column:
    """``-12345`` at scale 2 -> ``-123.45``; exact, no grouping."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    digits = F.abs(minor).cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), scale + 1), F.lit("0"))
    whole = F.left(padded, F.length(padded) - scale)
    body = F.when(scale == 0, digits).otherwise(F.concat(whole, F.lit("."), F.right(padded, scale)))
    return F.when(minor < 0, F.concat(F.lit("-"), body)).otherwise(body)
