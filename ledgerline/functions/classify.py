"""Small closed-set classifications."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ledgerline import rules


def transaction_type(text: Column, lowered: Column, amount: Column) -> Column:
    """Ordered keyword rules over ``type description``, else the sign.

    ``lowered`` is the text in lower case. A rule's pattern runs only where one
    of its literal stems occurs, which spares most texts all twelve patterns.
    """
    expr = F
    for pattern, kind in rules.TYPE_RULES:
        stems = [F.contains(lowered, F.lit(stem)) for stem in rules.TYPE_STEMS[kind]]
        expr = expr.when(reduce(or_, stems) & text.rlike(pattern), F.lit(kind))
    return expr.when(amount < 0, F.lit("DEBIT")).otherwise(F.lit("CREDIT"))


def indicates_debit(indicator: Column) -> Column:
    return indicator.rlike(rules.DEBIT_INDICATOR)


def row_band(rows: Column) -> Column:
    return F.when(rows <= 50, "1-50").when(rows <= 200, "51-200").when(rows <= 1000, "201-1000").otherwise("1000+")


def humanise(code: Column) -> Column:
    """``some-unknown-code`` -> ``Some unknown code``."""
    spaced = F.trim(F.regexp_replace(code, "[-_]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def issue_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(rules.ISSUE_LABELS), code), humanise(code))


def issue_status(level: Column) -> Column:
    return F.when(level == "error", "fail").when(level == "warning", "warn").otherwise("pass")
