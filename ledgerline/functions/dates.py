"""Reading dates out of text under an inferred day/month order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import rules
from ledgerline.functions.staged import Parser, Quick, parse
from ledgerline.functions.text import BLANK_CLASS, BLANKS, strip

_SEPARATORS = rf"[/\-.,{BLANK_CLASS}]+"
_SEPARATOR_CHARS = "/-.," + BLANKS
_TIME = r"(?s)^(.*?)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
_MONTH_LINE = " ".join(rules.MONTHS)


def month_number(token: Column) -> Column:
    """1..12 when the token starts with a month name, else NULL."""
    short = F.lower(F.substring(token, 1, 3))
    at = F.instr(F.lit(_MONTH_LINE), short)
    hit = (F.length(short) == 3) & (at > 0) & ((at - 1) % 4 == 0) & (F.instr(short, " ") == 0)
    return F.when(hit, ((at - 1) / 4 + 1).cast("int"))


# A number that is not all zeros, and a token that starts like a month.
_NUMBER = "(?!0+(?![0-9]))[0-9]"
_NAMED = rf"(?i:{'|'.join(rules.MONTHS)})[^/\-.,{BLANK_CLASS}]*+"


def _three(token: str) -> str:
    return rf"(?:{_SEPARATORS})?{token}(?:{_SEPARATORS}{token}){{2}}(?:{_SEPARATORS})?"


def day_text(value: Column) -> Column:
    """A text without the clock and what follows it, stripped."""
    t = strip(value)
    return F.when(F.contains(t, F.lit(":")), strip(F.regexp_replace(t, r"(?s)[0-9]{1,2}:[0-9]{2}.*$", ""))).otherwise(t)


def is_day_text(portion: Column) -> Column:
    """Whether a `day_text` is a date. What begins with neither a number nor a month is told by that alone."""
    edge = rf"(?:^|[/\-.,{BLANK_CLASS}])[0-9]{{4}}(?:[/\-.,{BLANK_CLASS}]|$)"
    any_number = rf"(?:{_NUMBER}{{1,4}}+|{_NAMED})"
    small = rf"(?:(?!0+(?![0-9]))(?:[0-9]{{1,2}}|0[0-9]{{2}})(?![0-9])|{_NAMED})"
    begun = portion.rlike(rf"^(?:{_SEPARATORS})?(?:[0-9]|(?i:{'|'.join(rules.MONTHS)}))")
    shaped = (
        portion.rlike("^[0-9]{8}$")
        | portion.rlike(f"^{_three(small)}$")
        | (portion.rlike(edge) & portion.rlike(f"^{_three(any_number)}$"))
    )
    return begun & shaped


def is_date_text(value: Column) -> Column:
    """Whether `with_date_parts` would accept the value, as one predicate.

    Usable inside array expressions, where staged columns are not.
    """
    return is_day_text(day_text(value))


def _digits(token: Column) -> Column:
    return (token != "") & (F.translate(token, "0123456789", "") == "")


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (
        F.when(month.isin(4, 6, 9, 11), F.lit(30))
        .when((month == 2) & leap, F.lit(29))
        .when(month == 2, F.lit(28))
        .otherwise(F.lit(31))
    )


def expand_year(year: Column) -> Column:
    """Two-digit years: 70-99 are 19xx, 00-69 are 20xx."""
    return F.when(year >= 100, year).when(year >= 70, year + 1900).otherwise(year + 2000)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or NULL when the three numbers are not one."""
    valid = month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month)) & year.between(1, 9999)
    return F.when(valid, F.make_date(year, month, day))


# Three numbers with one separator and a four-digit year at an end; a clock may follow a leading year.
_USUAL = r"\A(?:[0-9]{1,2}([/.\-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}([/.\-])[0-9]{1,2}\2[0-9]{1,2}(?: [0-9]{2}:[0-9]{2}:[0-9]{2})?)\z"


def _usual_date(value: Column, finish: Callable[[dict[str, Column]], dict[str, Column]]) -> Quick:
    """The quick way of `date_parts`: blank cells, and dates of the usual shape without a zero in the place of a number."""

    def shape(v):
        return {"usual": value.rlike(_USUAL)}

    def day(v):
        return {"day": F.when(v("usual"), F.translate(F.substring_index(value, " ", 1), "-.", "//"))}

    def numbers(v):
        pieces = [F.substring_index(v("day"), "/", 1), F.substring_index(F.substring_index(v("day"), "/", 2), "/", -1), F.substring_index(v("day"), "/", -1)]
        clock = [F.when(v("usual") & F.contains(value, F.lit(":")), F.substring(value, at, 2)).try_cast("int") for at in (-8, -5, -2)]
        return {f"q{i}": piece.try_cast("int") for i, piece in enumerate(pieces)} | dict(zip(("hour", "minute", "second"), clock))

    def ready(v):
        return (value == "") | (v("usual") & (F.least(v("q0"), v("q1"), v("q2")) >= 1))

    def fields(v):
        h, m, s = v("hour"), v("minute"), v("second")
        found = v("usual")
        separator = F.when(F.contains(value, F.lit("/")), F.lit("/")).when(F.contains(value, F.lit("-")), F.lit("-")).otherwise(F.lit("."))
        values = [found, v("q0"), v("q1"), v("q2"), F.when(found, separator), F.when(found, F.lit(-1))]
        # Only a leading year has more than two digits before the first separator.
        values += [F.when(found, F.when(F.length(F.substring_index(v("day"), "/", 1)) == 4, F.lit(0)).otherwise(F.lit(2)))]
        values += [F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)]
        return finish(dict(zip(PARTS, values)))

    return Quick([shape, day, numbers], ready, fields)


PARTS = ["is_date", "a", "b", "c", "separator", "alpha_month_at", "year_at", "time_seconds"]


def date_parts(value: Column, order: Column | None = None) -> Parser:
    """Parser of a date text into `PARTS`, without deciding what they mean.

    ``alpha_month_at`` and ``year_at`` are token positions or -1,
    ``time_seconds`` is the time of day. All but ``is_date`` are NULL when the
    value is no date. With an order, ``date`` is the calendar date under it.
    """

    def trimmed(v):
        return {"t": strip(value)}

    def clock(v):
        # The colon test is cheap and spares most cells the pattern.
        return {"timed": F.contains(v("t"), F.lit(":")) & v("t").rlike(_TIME)}

    def portion(v):
        def part(i):
            return F.when(v("timed"), F.regexp_extract(v("t"), _TIME, i).try_cast("int"))
        return {
            "dp": F.when(v("timed"), F.btrim(F.regexp_extract(v("t"), _TIME, 1), F.lit(BLANKS))).otherwise(v("t")),
            "h": part(2),
            "mi": part(3),
            "s": F.when(v("timed"), F.coalesce(part(4), F.lit(0))),
        }

    def words(v):
        spaced = F.trim(F.translate(v("dp"), _SEPARATOR_CHARS, " " * len(_SEPARATOR_CHARS)))
        return {
            "w": F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced),
            "sec": F.when((v("h") <= 23) & (v("mi") <= 59) & (v("s") <= 59), v("h") * 3600 + v("mi") * 60 + v("s")),
            "compact": (F.length(v("dp")) == 8) & _digits(v("dp")),
        }

    def tokens(v):
        three = F.length(v("w")) - F.length(F.translate(v("w"), " ", "")) == 2
        pieces = [
            F.substring_index(v("w"), " ", 1),
            F.substring_index(F.substring_index(v("w"), " ", 2), " ", -1),
            F.substring_index(v("w"), " ", -1),
        ]
        out = {"three": three}
        for i, (at, size) in enumerate(((1, 4), (5, 2), (7, 2))):
            out[f"k{i}"] = F.when(v("compact"), F.substring(v("dp"), at, size)).when(three, pieces[i])
        return out

    def numbers(v):
        out = {}
        for i in range(3):
            token = v(f"k{i}")
            numeric = _digits(token)
            out[f"n{i}"] = F.when(numeric & (F.length(token) <= 4), token.try_cast("int")).when(~numeric, month_number(token))
            out[f"a{i}"] = ~numeric
            out[f"y{i}"] = numeric & (F.length(token) == 4)
        return out

    def judge(v):
        n0, n1, n2 = v("n0"), v("n1"), v("n2")
        in_range = (F.least(n0, n1, n2) >= 1) & (v("y0") | v("y1") | v("y2") | (F.greatest(n0, n1, n2) <= 99))
        whole = n0.isNotNull() & n1.isNotNull() & n2.isNotNull()
        # The compact form is accepted before any range check.
        return {"ok": v("compact") | F.coalesce(v("three") & whole & in_range, F.lit(False))}

    def parts(v):
        compact, ok = v("compact"), v("ok")
        year_at = F.when(compact, F.lit(0)).when(v("y2"), F.lit(2)).when(v("y1"), F.lit(1)).when(v("y0"), F.lit(0)).otherwise(F.lit(-1))
        alpha_at = F.when(v("a2"), F.lit(2)).when(v("a1"), F.lit(1)).when(v("a0"), F.lit(0)).otherwise(F.lit(-1))
        separator = (
            F.when(compact, F.lit(None).cast("string"))
            .when(F.contains(v("dp"), F.lit("/")), F.lit("/"))
            .when(F.contains(v("dp"), F.lit("-")), F.lit("-"))
            .when(F.contains(v("dp"), F.lit(".")), F.lit("."))
            .otherwise(F.lit(" "))
        )
        values = [ok, *[F.when(ok, v(f"n{i}")) for i in range(3)], F.when(ok, separator)]
        values += [F.when(ok, F.when(compact, F.lit(-1)).otherwise(alpha_at)), F.when(ok, year_at), F.when(ok, v("sec"))]
        return dict(zip(PARTS, values))

    steps = [trimmed, clock, portion, words, tokens, numbers, judge]
    if order is None:
        return Parser(steps, parts, _usual_date(value, lambda part: part))

    def fields(v):
        return {"is_date": v("is_date"), "time_seconds": v("time_seconds"), "date": calendar_date(v("y"), v("m"), v("d"))}

    def finish(part):
        return fields((part | year_month_day(part.__getitem__, order)).__getitem__)

    return Parser([*steps, parts, lambda v: year_month_day(v, order)], fields, _usual_date(value, finish))


def with_date_parts(df: DataFrame, raw: str, prefix: str) -> DataFrame:
    """Tokenise a date column into ``{prefix}_<part>`` columns."""
    return parse(df, {prefix: date_parts(F.col(raw))})


def date_from_parts(prefix: str, order: Column) -> Column:
    """The calendar date of `with_date_parts` columns under an order, else NULL."""
    x = year_month_day(lambda name: F.col(f"{prefix}_{name}"), order)
    return calendar_date(x["y"], x["m"], x["d"])


def year_month_day(part, order: Column) -> dict[str, Column]:
    """Which part is which under an order; ``part(name)`` gives each."""
    a, b, c = (part(x) for x in "abc")
    alpha, year_at = part("alpha_month_at"), part("year_at")
    # A leading four-digit year overrides the orders that expect it elsewhere.
    leading_year = (year_at == 0) & ~order.isin("YMD", "YDM")
    shape = (
        F.when(leading_year, F.lit("YMD"))
        .when(alpha == 1, F.lit("DMY"))
        .when(alpha == 0, F.lit("MDY"))
        .when(alpha == 2, F.lit("YDM"))
        .otherwise(order)
    )
    year = F.when(shape.isin("YMD", "YDM"), a).otherwise(c)
    month = F.when(shape == "MDY", a).when(shape == "YDM", c).otherwise(b)
    day = F.when(shape == "YMD", c).when(shape == "DMY", a).otherwise(b)
    return {"y": expand_year(year), "m": month, "d": day}


# --- the lighter reader used by the quality checks --------------------------


PREVIEW_PARTS = ["looks", "a", "b", "c", "alpha", "iso"]


def preview_parts(value: Column) -> Parser:
    """Parser of a date text as the lighter reader sees it."""

    def words(v):
        day = F.substring_index(F.substring_index(v("v"), "T", 1), " ", 1)
        spaced = F.trim(F.translate(day, "/-.", "   "))
        return {"w": F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)}

    def tokens(v):
        compact = (F.length(v("v")) == 8) & _digits(v("v"))
        three = F.length(v("w")) - F.length(F.translate(v("w"), " ", "")) == 2
        middle = F.substring_index(F.substring_index(v("w"), " ", 2), " ", -1)
        return {
            "compact": compact,
            "p0": F.when(compact, F.substring(v("v"), 1, 4)).when(three, F.substring_index(v("w"), " ", 1)),
            "p1": F.when(compact, F.substring(v("v"), 5, 2)).when(three, middle),
            "p2": F.when(compact, F.substring(v("v"), 7, 2)).when(three, F.substring_index(v("w"), " ", -1)),
        }

    def numbers(v):
        alpha = month_number(v("p1"))
        return {
            "al": alpha,
            "n0": F.when(_digits(v("p0")), v("p0").try_cast("int")),
            "n1": F.coalesce(alpha, F.when(_digits(v("p1")), v("p1").try_cast("int"))),
            "n2": F.when(_digits(v("p2")), v("p2").try_cast("int")),
        }

    def verdict(v):
        looks = v("n0").isNotNull() & v("n1").isNotNull() & v("n2").isNotNull()
        return {"looks": looks, "alpha": looks & v("al").isNotNull()}

    def parts(v):
        looks, alpha = v("looks"), v("alpha")
        iso = looks & ~alpha & F.coalesce(v("compact") | (F.length(v("p0")) == 4), F.lit(False))
        values = [looks, *[F.when(looks, v(f"n{i}")) for i in range(3)], alpha, iso]
        return dict(zip(PREVIEW_PARTS, values))

    return Parser([lambda v: {"v": strip(value)}, words, tokens, numbers, verdict], parts, _usual_preview(value))


def _usual_preview(value: Column) -> Quick:
    """The quick way of `preview_parts`: blank cells, and dates of the usual shape, whatever their numbers."""

    def shape(v):
        return {"usual": value.rlike(_USUAL)}

    def day(v):
        return {"day": F.when(v("usual"), F.translate(F.substring_index(value, " ", 1), "-.", "//"))}

    def numbers(v):
        first = F.substring_index(v("day"), "/", 1)
        pieces = [first, F.substring_index(F.substring_index(v("day"), "/", 2), "/", -1), F.substring_index(v("day"), "/", -1)]
        return {f"q{i}": piece.try_cast("int") for i, piece in enumerate(pieces)} | {"lead": F.length(first) == 4}

    def fields(v):
        values = [v("usual"), v("q0"), v("q1"), v("q2"), F.lit(False), v("usual") & v("lead")]
        return dict(zip(PREVIEW_PARTS, values))

    return Quick([shape, day, numbers], lambda v: (value == "") | v("usual"), fields)


def with_preview_parts(df: DataFrame, raw: str, prefix: str) -> DataFrame:
    return parse(df, {prefix: preview_parts(F.col(raw))})


def preview_order(prefix: str, included: Column | None = None) -> Column:
    """Aggregate expression: ISO / DMY / MDY / AMBIGUOUS / UNKNOWN per group."""
    use = F.lit(True) if included is None else included
    a, b = F.col(f"{prefix}_a"), F.col(f"{prefix}_b")
    looks, alpha, iso = (use & F.col(f"{prefix}_{x}") for x in ("looks", "alpha", "iso"))
    plain = looks & ~F.col(f"{prefix}_alpha") & ~F.col(f"{prefix}_iso")
    seen = F.count_if(looks)
    isos = F.count_if(iso)
    dmy = F.count_if(alpha | (plain & (a > 12) & (b <= 12)))
    mdy = F.count_if(plain & (b > 12) & (a <= 12))
    return (
        F.when(seen == 0, F.lit("UNKNOWN"))
        .when(isos == seen, F.lit("ISO"))
        .when((dmy > 0) & (mdy > 0), F.lit("UNKNOWN"))
        .when(dmy > 0, F.lit("DMY"))
        .when(mdy > 0, F.lit("MDY"))
        .otherwise(F.lit("AMBIGUOUS"))
    )


def preview_ordinal(prefix: str, order: Column) -> Column:
    """Days since 1970-01-01 under the column order, for ordering only.

    Days past the end of a month roll over into the next one, as an ordinal
    needs no calendar check beyond 1..31.
    """
    a, b, c = (F.col(f"{prefix}_{x}") for x in "abc")
    iso, alpha = F.col(f"{prefix}_iso"), F.col(f"{prefix}_alpha")
    dayfirst = alpha | (order == "DMY")
    year = F.when(iso, a).when(dayfirst | (order == "MDY"), c)
    month = F.when(iso, b).when(dayfirst, b).when(order == "MDY", a)
    day = F.when(iso, c).when(dayfirst, a).when(order == "MDY", b)
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    valid = F.col(f"{prefix}_looks") & month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    return F.when(valid, F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1)


# --- rendering --------------------------------------------------------------


def render_date(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def render_datetime(date: Column, seconds: Column, suffix: Column) -> Column:
    def two(x):
        return F.lpad(x.cast("string"), 2, "0")
    clock = F.concat(two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    return F.concat(render_date(date), clock, suffix)
