"""Splitting delimited text into records and cells with quotes honoured.

The patterns are possessive throughout: Java then matches them in a loop, so a
quoted field of any length is safe. A quote opens a quoted cell only at the
start of the cell.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ledgerline import rules
from ledgerline.functions.text import BLANK_CLASS, strip

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _cell(d: str) -> str:
    return rf"(?:{_QUOTED}[^{d}\r\n]*+|[^{d}\r\n]*+)"


def record_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    return rf"{_cell(d)}(?:{d}{_cell(d)})*+"


def head_pattern(delimiter: str, records: int) -> str:
    """The first records of a text, blank ones skipped but not counted."""
    d = re.escape(delimiter)
    line_end = r"(?:\r\n|[\r\n]|\z)"
    blank = rf'(?:[{d}"{BLANK_CLASS}&&[^\r\n]]*+[\r\n])*+'
    return rf"\A(?:{blank}{record_pattern(delimiter)}{line_end}){{0,{records}}}+"


def by_delimiter(delimiter: Column, make) -> Column:
    """One branch per candidate, so every pattern is a constant."""
    expr = F
    for d in rules.DELIMITERS:
        expr = expr.when(delimiter == d, make(d))
    return expr


def split_cells(record: Column, delimiter: str) -> Column:
    """Cells of one record, unquoted."""
    d = re.escape(delimiter)
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(_delimited(d)), F.lit(1))

    def unquote(c: Column) -> Column:
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        quoted = c.rlike(rf"(?s)^{_QUOTED}$")
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)

    # Without a quote every delimiter parts two cells.
    return F.when(F.contains(record, F.lit('"')), F.transform(raw, unquote)).otherwise(F.split(record, d))


def _delimited(d: str) -> str:
    return rf"{d}({_QUOTED}[^{d}]*+|[^{d}]*+)"


def _lines(text: Column, delimiter: str) -> Column:
    """The records of a text as they stand. Without a quote every line end parts two records."""
    quoted = F.regexp_extract_all(text, F.lit(record_pattern(delimiter)), F.lit(0))
    return F.filter(F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.split(text, "[\r\n]")), lambda r: r != "")


def records(text: Column, delimiter: str) -> Column:
    """All non-blank records of a text as arrays of cells."""
    cells = F.transform(_lines(text, delimiter), lambda r: split_cells(r, delimiter))
    return F.filter(cells, lambda row: F.exists(row, lambda c: strip(c) != ""))


def record_widths(text: Column, delimiter: str) -> Column:
    """How many cells each of the `records` has, without making them."""
    d = re.escape(delimiter)

    def filled(r: Column) -> Column:
        # Only a record of nothing but quotes, delimiters and blanks needs its cells to tell.
        return r.rlike(rf'[^{d}"{BLANK_CLASS}]') | F.exists(split_cells(r, delimiter), lambda c: strip(c) != "")

    def width(r: Column) -> Column:
        parted = F.length(r) - F.length(F.replace(r, F.lit(delimiter), F.lit(""))) + 1
        return F.when(F.contains(r, F.lit('"')), F.regexp_count(F.concat(F.lit(delimiter), r), F.lit(_delimited(d)))).otherwise(parted)

    return F.transform(F.filter(_lines(text, delimiter), filled), width)
