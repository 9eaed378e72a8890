"""Text expressions: trimming, header keys, ASCII folding, token cleaning."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from ledgerline import rules

# Characters the statement formats treat as blank. Spark's `trim` knows only
# the space and Java's `\s` only the ASCII ones.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set inside a Java character class.
BLANK_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(value: Column) -> Column:
    """Trim every blank, not only spaces.

    A text that starts and ends in printable ASCII needs no trimming; that test
    reads two bytes, the full trim compares with every blank.
    """
    first, last = F.ascii(value), F.ascii(F.substring(value, -1, 1))
    return F.when(first.between(33, 126) & last.between(33, 126), value).otherwise(F.btrim(value, F.lit(BLANKS)))


def blank(value: Column) -> Column:
    return strip(value) == ""


def first_match(value: Column, table, default: Column | None = None) -> Column:
    """Ordered (pattern, result) rules as one CASE; the first hit wins."""
    expr = F
    for pattern, result in table:
        expr = expr.when(value.rlike(pattern), F.lit(result))
    return expr.otherwise(default) if default is not None else expr


def header_key(header: Column) -> Column:
    """Key a detected header is matched on: lower, punctuation to space."""
    lowered = F.lower(header)
    spaced = F.regexp_replace(F.translate(lowered, "_.", "  "), "[^a-z0-9#/ ]+", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def layout_key(header: Column) -> Column:
    """Key a declared layout header is matched on: trimmed, lower, one space."""
    return F.regexp_replace(F.lower(strip(header)), f"[{BLANK_CLASS}]+", " ")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def download_name(source_name: Column, dialect: Column) -> Column:
    """``My Bank (2024).csv`` -> ``my_bank_2024_converted.ofx``."""
    slug = F.regexp_replace(F.lower(file_stem(source_name)), "[^a-z0-9]+", "_")
    slug = F.substring(F.trim(F.btrim(slug, F.lit("_"))), 1, rules.FILE_SLUG_CAP)
    slug = F.coalesce(F.nullif(slug, F.lit("")), F.lit(rules.FILE_SLUG_EMPTY))
    return F.concat(slug, F.lit("_converted."), dialect)


def account_key(supplied: Column, file_name: Column) -> Column:
    """The supplied account id, else the file's base name."""
    return F.coalesce(F.nullif(strip(supplied), F.lit("")), file_stem(file_name))


def id_token(value: Column, cap: int) -> Column:
    """Keep only characters an identifier leaf may hold.

    Most values hold no others. The word class, the same ASCII letters, digits
    and underscore, is a table in Java, and far faster to ask than ranges.
    """
    kept = F.when(value.rlike(r"[^\w.-]"), F.regexp_replace(value, "[^A-Za-z0-9._-]", "")).otherwise(value)
    return F.substring(kept, 1, cap)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[int, str]]:
    """Characters that fold to one ASCII letter, and those that unfold to several.

    Built from canonical decomposition: decompose, drop U+0300..U+036F, look at
    what remains. One ASCII character remains for accented Latin letters; several
    characters remain for Hangul syllables and voiced kana.
    """
    source, target = [], []
    unfolded: dict[int, list[str]] = {}
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF or 0x300 <= point <= 0x36F:
            continue
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        parts = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if len(parts) == 1:
            if ord(parts) < 0x80:
                source.append(char)
                target.append(parts)
        else:
            unfolded.setdefault(len(parts), []).append(char)
    for curly, plain in (("\u2018\u2019\u201b", "'"), ("\u201c\u201d", '"'), ("\u2010\u2011\u2012\u2013\u2014\u2015", "-")):
        source.extend(curly)
        target.extend(plain * len(curly))
    classes = {}
    for size, chars in unfolded.items():
        classes[size] = "[" + _ranges(chars) + "]"
    return "".join(source), "".join(target), classes


def _ranges(chars: list[str]) -> str:
    """A sorted character list as a compact class body."""
    out, points = [], sorted(ord(c) for c in chars)
    start = previous = points[0]
    for point in points[1:] + [None]:
        if point is not None and point == previous + 1:
            previous = point
            continue
        out.append(f"\\u{start:04x}" if start == previous else f"\\u{start:04x}-\\u{previous:04x}")
        start = previous = point
    return "".join(out)


def ascii_fold(value: Column) -> Column:
    """ASCII form of a text: marks dropped, quotes and dashes plain, rest ``?``.

    Printable ASCII, the common case, only has its spaces collapsed.
    """
    spaced = F.regexp_replace(value, "  +", " ")
    return F.when(value.rlike(r"[^\x20-\x7e]"), _fold_all(value)).otherwise(spaced)


def _fold_all(value: Column) -> Column:
    source, target, classes = _folding()
    out = F.translate(value, source, target)
    out = F.regexp_replace(out, r"[\u0300-\u036f\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.replace(F.replace(F.replace(out, F.lit("€"), F.lit("EUR")), F.lit("£"), F.lit("GBP")), F.lit("₹"), F.lit("INR"))
    out = F.regexp_replace(out, r"[\t\n\r \u00a0]+", " ")
    unfolded = out
    for size, members in sorted(classes.items()):
        unfolded = F.regexp_replace(unfolded, members, "?" * size)
    # The classes are long; Latin texts and general punctuation hold none of them.
    wide = value.rlike(r"[\u0300-\u1fff\u2100-\uffff]")
    return F.regexp_replace(F.when(wide, unfolded).otherwise(out), r"[^\x00-\x7e]", "?")


def escaped_text(value: Column) -> Column:
    """Folded, escaped and trimmed text of a markup leaf."""
    out = F.replace(ascii_fold(value), F.lit("&"), F.lit("&amp;"))
    return F.trim(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))


def markup_text(value: Column, cap: int) -> Column:
    """`escaped_text` cut to a length; a cut entity is dropped.

    Printable ASCII that needs no folding, escaping or cutting is only trimmed.
    For the rest, looks at one character more than the cap and puts a marker in its
    place when there is one, so that the text itself is evaluated once.
    """
    plain = (F.length(value) <= cap) & ~value.rlike(r"[^\x20-\x7e]|[&<>]|  ")
    head = F.substring(escaped_text(value), 1, cap + 1)
    marked = F.regexp_replace(head, rf"(?s)^(.{{{cap}}}).$", "$1\u0001")
    return F.when(plain, F.trim(value)).otherwise(F.rtrim(F.regexp_replace(marked, "(&[^;&]*)?\u0001$", "")))
