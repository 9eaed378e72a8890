"""Secret scans in native expressions: three patterns and sliding-window entropy.

Patterns give the base spans. Candidate strings (long runs of key characters with
a letter and a digit) are scanned by a window whose sum of n * log2(n) over its
character counts changes by the character that leaves and the one that enters;
windows above the bound of the string's character class make one more span,
unless the string is on the allow list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# (class of the whole string, bits a window needs); the first class that fits counts.
CLASSES = [(r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Z0-9]+$", 3.4), (r"^[A-Za-z0-9+/_=-]+$", 3.7)]
# Strings that look random but name things: placeholders, alphabets, UUIDs, dashed words and paths.
ALLOWED = [
    r"(?i)example|sample|placeholder|dummy|your[_-]?(key|token)",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([/_-]+[A-Za-z]*[0-9]{0,4})*$",
]
# The same without a second try at what was read: long strings are then matched in a loop.
POSSESSIVE = {ALLOWED[3]: r"^[A-Za-z]++(?:[/_-]++[A-Za-z]*+[0-9]{0,4}+)*+$"}
# The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Matches whose places are summed in one go.
CHUNK = 128
REDACTED = "[REDACTED]"


def _spans(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Array of (start, kind, end, value) of the leftmost matches; code points, end exclusive.

    Java gives no match offsets, so they are summed from the pieces between matches.
    """
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = value if least is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def state(at: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), x["value"].alias("value"))
        kept = F.array(one) if least is None else F.filter(F.array(one), lambda _: F.length(x["group"]) >= least)
        return F.struct(end.cast("int").alias("at"), F.concat(s["found"], kept).alias("found"))

    def numbered(m: Column) -> Column:
        # Chunks, as an array that grows by one is copied each time.
        def chunk(k: Column) -> Column:
            return F.slice(m, k * CHUNK + 1, F.lit(CHUNK))

        chunks = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        lengths = F.transform(chunks, lambda k: F.aggregate(chunk(k), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["value"])))
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(lengths, begun, lambda b, n: F.struct((b["at"] + n).alias("at"), F.concat(b["starts"], F.array(b["at"])).alias("starts")), lambda b: b["starts"])
        placed = F.arrays_zip(chunks.alias("k"), starts.alias("start"))
        return F.flatten(F.transform(placed, lambda c: F.aggregate(chunk(c["k"]), state(c["start"]), step, lambda s: s["found"])))

    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(value))
    return _bound(F.arrays_zip(gaps.alias("gap"), value.alias("value"), group.alias("group")), numbered)


def _bound(value: Column, use) -> Column:
    """An expression of a value that it uses several times, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hot_windows(value: Column) -> Column:
    """(first, last) start of a window above the bound of the string's class; nulls if there is none.

    The counts of the window's characters are kept in an array, which the character
    that leaves and the one that enters change at each move.
    """
    bound = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        bound = F.when(value.rlike(pattern), F.lit(bits)).otherwise(bound)

    def weight(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def seen(counts: Column, s: Column, at: Column, first: Column, last: Column, least: Column) -> Column:
        hot = F.round(F.lit(math.log2(WINDOW)) - s / WINDOW, 9) >= least
        return F.struct(
            counts.alias("counts"), s.alias("s"), (at + 1).alias("at"), F.when(hot, F.coalesce(first, at)).otherwise(first).alias("first"), F.when(hot, at).otherwise(last).alias("last"), least.alias("least")
        )

    def scan(chars: Column) -> Column:
        window = F.slice(chars, F.lit(1), F.lit(WINDOW))
        counts = F.transform(F.array(*[F.lit(i) for i in range(1, len(ALPHABET) + 1)]), lambda c: F.size(F.filter(window, lambda x: x == c)))
        start = F.aggregate(counts, F.lit(0.0), lambda s, n: s + weight(n))
        many = F.greatest(F.size(chars) - WINDOW, F.lit(0))
        moves = F.arrays_zip(F.slice(chars, F.lit(1), many).alias("leaves"), F.slice(chars, F.lit(WINDOW + 1), many).alias("enters"))

        def step(state: Column, move: Column) -> Column:
            leaves, enters = move["leaves"], move["enters"]
            n = F.get(state["counts"], leaves - 1)
            m = F.get(state["counts"], enters - 1) - F.when(leaves == enters, 1).otherwise(0)
            s = state["s"] + weight(n - 1) - weight(n) + weight(m + 1) - weight(m)
            moved = F.transform(state["counts"], lambda x, k: x - F.when(k + 1 == leaves, 1).otherwise(0) + F.when(k + 1 == enters, 1).otherwise(0))
            return F.when(leaves == enters, seen(state["counts"], state["s"], state["at"], state["first"], state["last"], state["least"])).otherwise(
                seen(moved, s, state["at"], state["first"], state["last"], state["least"])
            )

        none = F.lit(None).cast("int")
        return F.aggregate(moves, seen(counts, start, F.lit(0), none, none, bound), step)

    return _bound(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c)), scan)


def _entropy_spans(text: Column) -> Column:
    allowed = F.lit(False)
    usable = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~_any(x["value"])

    def _any(value: Column) -> Column:
        out = allowed
        for pattern in ALLOWED:
            out = out | value.rlike(POSSESSIVE.get(pattern, pattern))
        return out

    strings = F.filter(_spans(text, CANDIDATE, 3), usable)
    scanned = F.transform(strings, lambda x: F.struct(x["start"].alias("start"), _hot_windows(x["value"]).alias("hot")))
    hot = F.filter(scanned, lambda x: x["hot"]["first"].isNotNull())
    return F.transform(
        hot,
        lambda x: F.struct(
            (x["start"] + x["hot"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["hot"]["last"] + WINDOW).alias("end"), F.lit("").alias("value")
        ),
    )


def find_secrets(docs: DataFrame, text_column: str = "text", found_column: str = "secret_spans") -> DataFrame:
    """`docs` with an array of (start, kind, end): kinds assign 0, access 1, hex 2, entropy 3, ordered by start, then kind.

    Null and empty texts have an empty array. Whole texts of any length are
    scanned; every row keeps its place, repeated rows included. An input column
    named like the new one is replaced.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # One cheap scan finds the few rows that need offsets at all.
    anything = text.rlike(ASSIGN) | text.rlike(CANDIDATE)
    found = F.concat(
        _spans(text, ASSIGN, 0, F.lit(ASSIGN_LENGTH)), _spans(text, ACCESS, 1), _spans(text, HEX, 2), _entropy_spans(text)
    )
    bare = F.transform(F.array_sort(found), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return docs.withColumn(found_column, F.when(anything, bare).otherwise(empty))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    found = find_secrets(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), "text", "found")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{name}": count(kind) for kind, name in enumerate(KINDS[:3])}
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with every span replaced by a marker; overlapping spans become one marker. Other rows stay as they are."""
    found = find_secrets(docs, text_column, "__spans")
    text = F.col(text_column)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(REDACTED))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    clean = F.aggregate("__spans", state, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return found.withColumn(text_column, F.when(F.size("__spans") > 0, clean).otherwise(text)).drop("__spans")
