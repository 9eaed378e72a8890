"""Files too large to be one row: read in splits, line by line.

Spark's text reader cuts a file into byte ranges and gives whole lines. A quoted
cell may hold line ends, so whether a line begins inside one depends on all lines
before it. But what a line does to that state is one of four functions (keep it,
change it, end inside, end outside), and those add up: a running sum inside each
range and one small row per range give the state everywhere. Lines that belong
together are joined, and everything else is per record, so no file is ever one
row or one task. The result is what `layout.lay_out` finds for whole files.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerline import rules
from ledgerline.functions.records import by_delimiter, records
from ledgerline.functions.text import strip
from ledgerline.operators.layout import header_position, modal_vote
from ledgerline.operators.skew import number_rows
from ledgerline.session import staged
from ledgerline.sources.landing import control_characters, judge, resolve_encoding

# A longer line is not held in memory: a file with one is refused, never cut.
LONGEST_LINE = 64 << 20
# How lines are parted: the separator and the charset it is written in.
MODES = {"lf": ("\n", None), "cr": ("\r", None), "utf-16le": ("\n", "UTF-16LE"), "utf-16be": ("\n", "UTF-16BE")}
DELIMITERS = list(enumerate(rules.DELIMITERS))


class Large(NamedTuple):
    """Triage of every large file, layout of the readable ones, and their body rows."""

    judged: DataFrame
    heads: DataFrame
    rows: DataFrame


def scan_lines(spark: SparkSession, path: str, mode: str = "lf", over: int = rules.MAX_INPUT_BYTES, longest: int = LONGEST_LINE) -> DataFrame:
    """Lines of the accepted files of more than `over` bytes: ``(file_id, file_name, length, block, seq, value)``.

    Smaller files are left out before they are read. ``block`` is the start of the byte range and
    ``seq`` grows within it, so both order the lines of a file. Lines beyond `longest` are left out.
    """
    separator, charset = MODES[mode]
    reader = (
        spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", rules.ACCEPTED_GLOB)
        .option("lineSep", separator).option("mapreduce.input.linerecordreader.line.maxlength", str(longest))
    )
    if charset:
        reader = reader.option("encoding", charset)
    raw = reader.load(path).where(F.col("_metadata.file_size") > over)
    # Paths come encoded here and plain from the scan of whole files.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(plain, "^file:/+", "file:/")
    return raw.select(
        plain.alias("file_id"),
        F.element_at(F.split(plain, "/"), -1).alias("file_name"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("value"),
    )


def _measured(lines: DataFrame) -> DataFrame:
    """What triage and the charset need of each file, and how many of its bytes the lines account for."""
    text = F.decode("value", "ISO-8859-1")
    place = F.struct("block", "seq")
    control = control_characters(text)
    return lines.groupBy("file_id", "file_name", "length").agg(
        (F.sum(F.octet_length("value")) + F.count(F.lit(1))).alias("seen"),
        F.max(F.contains(text, F.lit("\u0000"))).alias("__nul"),
        F.sum(control).alias("controls"),
        F.min(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"),
        F.max(F.contains(text, F.lit("\n"))).alias("feeds"),
        F.min_by(F.substring("value", 1, 64), place).alias("content"),
    )


def triage_lines(spark: SparkSession, path: str, over: int = rules.MAX_INPUT_BYTES, longest: int = LONGEST_LINE) -> DataFrame:
    """Triage of the large files as `landing.triage` does it, with the ``mode`` their lines are read in and ``utf8``.

    A file without line feeds is read by carriage returns. UTF-16 files are parted at their own line feeds.
    """

    def measured(mode: str) -> DataFrame:
        # The last line may or may not have an end, and the reader takes a UTF-8 mark off the first one.
        found, more = _measured(scan_lines(spark, path, mode, over, longest)), F.col("seen") - F.col("length")
        found = found.withColumns({"whole": more.between(0, 1) | more.between(-3, -2), "marked": more < 0, "ended": more.isin(0, -3)})
        mark = F.when(F.col("marked"), F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b""))
        return staged(found.withColumn("content", F.concat(mark, F.col("content"))), f"measured-{mode}")

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", rules.ACCEPTED_GLOB).load(path)
    listed = listed.where(F.col("length") > over).select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    fed = measured("lf")
    rest = listed.join(fed.where("whole").select("file_id"), "file_id", "left_anti")
    found = fed.where("whole").withColumn("mode", F.lit("lf"))
    if not rest.isEmpty():
        returned = measured("cr").where("whole AND NOT feeds").join(rest.select("file_id"), "file_id", "left_semi")
        found = found.unionByName(returned.withColumn("mode", F.lit("cr")))
    seen = listed.join(found.drop("file_name", "length", "seen", "feeds", "whole"), "file_id", "left").withColumn("__control", F.col("controls") / F.col("length"))
    wide = F.lower(F.hex(F.substring("content", 1, 2)))
    seen = seen.withColumn("mode", F.when(wide == "fffe", "utf-16le").when(wide == "feff", "utf-16be").otherwise(F.col("mode")))
    unread = F.col("mode").isNull()
    judged = judge(seen.withColumn("__nul", F.coalesce("__nul", F.lit(False))).withColumn("__control", F.coalesce("__control", F.lit(0.0))), keep=("utf8", "mode", "marked", "ended"))
    return judged.withColumns(
        {
            "kind": F.when(unread, "unreadable").otherwise(F.col("kind")),
            "reject_code": F.when(unread, "line-too-long").otherwise(F.col("reject_code")),
            "reject_message": F.when(unread, f"A line has more than {longest} bytes.").otherwise(F.col("reject_message")),
        }
    )


def _decoded(spark: SparkSession, path: str, files: DataFrame, over: int, longest: int) -> DataFrame:
    """Lines of the files as text, without the byte order mark; ``end`` is what stood between them."""
    out = None
    for mode in sorted(r["mode"] for r in files.select("mode").distinct().collect()):  # at most four
        lines = scan_lines(spark, path, mode, over, longest).drop("file_name", "length")
        named = lines.join(files.where(F.col("mode") == mode).select("file_id", "encoding", F.when(F.col("marked"), 0).otherwise(F.col("bom_length")).alias("bom_length")), "file_id")
        first = F.col("block") == 0
        skip = F.when(first & (F.col("seq") == F.min("seq").over(W.partitionBy("file_id", "block"))), F.col("bom_length")).otherwise(0)
        body = F.substring(F.col("value"), skip + 1, F.octet_length("value"))
        text = F
        for name, java in (dict(rules.CHARSETS.values()) | dict([rules.FALLBACK_CHARSET])).items():
            text = text.when(F.col("encoding") == name, F.decode(body, java))
        made = named.select("file_id", "block", "seq", text.alias("text"), F.lit(MODES[mode][0]).alias("end"))
        out = made if out is None else out.unionByName(made)
    return out


def _strict_cell(d: str) -> str:
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{d}\r]*+|(?!")[^{d}\r]*+)'


def opens(text: Column, delimiter: str) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    d = re.escape(delimiter)
    return text.rlike(rf'\A(?:{_strict_cell(d)}(?:{d}|\r))*+"[^"]*+(?:""[^"]*+)*+\z')


def stays(text: Column, delimiter: str) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one."""
    d = re.escape(delimiter)
    again = rf'"[^{d}\r]*+(?:{d}|\r)(?:{_strict_cell(d)}(?:{d}|\r))*+"[^"]*+(?:""[^"]*+)*+'
    return text.rlike(rf'\A[^"]*+(?:""[^"]*+)*+(?:{again})?+\z')


def _composed(out: Column, inside: Column, window) -> Column:
    """The function of all rows of a window: 0 or 1 if it ends there whatever the start, 2 keeps the start, 3 changes it.

    `out` and `inside` (0 or 1) are where a row ends that starts outside or inside.
    """
    changes = F.sum(F.when((out == 1) & (inside == 0), 1).otherwise(0)).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
    settled = F.when(out == inside, (out + changes) % 2)
    return F.struct(changes.alias("changes"), settled.alias("settled"))


def _functions(df: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """For each name with columns ``{name}_out`` and ``{name}_in``: the functions up to (``_after``) and before (``_before``) each row."""
    w = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({f"{n}_run": _composed(F.col(f"{n}_out"), F.col(f"{n}_in"), w) for n in names})

    def so_far(n: str, frame, changes: Column) -> Column:
        settled = F.last(F.col(f"{n}_run.settled"), ignorenulls=True).over(frame)
        changes = F.coalesce(changes, F.lit(0))
        return F.coalesce((settled + changes) % 2, 2 + changes % 2).cast("tinyint")

    to_here, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    made = {f"{n}_after": so_far(n, to_here, F.col(f"{n}_run.changes")) for n in names}
    made |= {f"{n}_before": so_far(n, before, F.lag(F.col(f"{n}_run.changes")).over(w)) for n in names}
    return df.withColumns(made).drop(*[f"{n}_{x}" for n in names for x in ("run", "out", "in")])


def _applied(function: str, start: str) -> Column:
    return F.when(F.col(function) < 2, F.col(function)).otherwise((F.col(function) + F.col(start)) % 2).cast("tinyint")


def line_states(lines: DataFrame) -> DataFrame:
    """The lines with ``states``: for each delimiter whether they begin (``before``) and end (``after``) inside a quoted cell.

    A cell that is opened and never closed is no quoted cell: from the line that opens it on, all lines stand alone.
    """
    names = [f"d{k}" for k, _ in DELIMITERS]
    quoted = F.contains(F.col("text"), F.lit('"'))
    single = {}
    for k, d in DELIMITERS:
        single[f"d{k}_out"] = F.when(quoted, opens(F.col("text"), d).cast("int")).otherwise(0)
        single[f"d{k}_in"] = F.when(quoted, stays(F.col("text"), d).cast("int")).otherwise(1)
    inner = staged(_functions(lines.withColumns(single), ["file_id", "block"], ["seq"], names), "line-functions")
    ranges = inner.groupBy("file_id", "block").agg(*[F.max_by(f"{n}_after", "seq").alias(n) for n in names])
    # A range ends inside: settled, or from its own start.
    ends = {f"{n}_out": F.when(F.col(n) < 2, F.col(n)).otherwise(F.col(n) - 2) for n in names}
    ends |= {f"{n}_in": F.when(F.col(n) < 2, F.col(n)).otherwise(3 - F.col(n)) for n in names}
    carried = _functions(ranges.withColumns(ends), ["file_id"], ["block"], names)
    # A file begins outside.
    starts = carried.select("file_id", "block", *[(F.col(f"{n}_before") % 2).alias(f"{n}_start") for n in names])
    known = inner.join(starts, ["file_id", "block"])
    known = known.withColumns({f"{n}_{x}": _applied(f"{n}_{x}", f"{n}_start") for n in names for x in ("before", "after")})
    place = F.struct("block", "seq")
    # A line that ends inside a cell opened it, unless it lies inside that cell altogether.
    within = F.col("text").rlike(r'\A[^"]*+(?:""[^"]*+)*+\z')
    ends = known.groupBy("file_id").agg(
        *[F.max_by(f"{n}_after", place).alias(f"{n}_last") for n in names],
        *[F.max(F.when((F.col(f"{n}_after") == 1) & ((F.col(f"{n}_before") == 0) | ~within), place)).alias(f"{n}_open") for n in names],
    )
    closed = known.join(ends, "file_id")

    def state(n: str) -> Column:
        open_, zero = F.col(f"{n}_last") == 1, F.lit(0).cast("tinyint")
        before = F.when(open_ & (place > F.col(f"{n}_open")), zero).otherwise(F.col(f"{n}_before"))
        after = F.when(open_ & (place >= F.col(f"{n}_open")), zero).otherwise(F.col(f"{n}_after"))
        return F.struct(before.alias("before"), after.alias("after"))

    return closed.select("file_id", "block", "seq", "text", "end", F.array(*[state(n) for n in names]).alias("states"))


def joined_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that a quoted cell runs across, joined: ``(*keys, block, seq, text)`` at the place of the first.

    `lines`: keys, block, seq, text, end, before, after, of such lines only. No task holds more than one range or one joined text.
    """
    own = W.partitionBy(*keys, "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = F.when(F.col("before") == 0, F.struct("block", "seq"))
    placed = lines.withColumn("begun", F.last(begun, ignorenulls=True).over(own))
    # A range that begins inside a cell goes on with what an earlier one began.
    last = placed.groupBy(*keys, "block").agg(F.max("begun").alias("begun"))
    earlier = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*keys, "block", F.last("begun", ignorenulls=True).over(earlier).alias("carried"))
    whole = placed.join(carried, [*keys, "block"]).withColumn("begun", F.coalesce("begun", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    texts = whole.groupBy(*keys, "begun", "end").agg(parts.alias("parts"))
    # The separator is the same within a file.
    return texts.select(*keys, "begun.block", "begun.seq", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "end").withColumn(
        "text", F.when(F.col("end") == "\n", F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.col("end")))
    ).drop("end")


def _state(k) -> list[Column]:
    at = F.get("states", k)
    return [at["before"].alias("before"), at["after"].alias("after")]


def _body(text: Column) -> Column:
    """A line without the carriage return of its end."""
    return F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _plain(text: Column) -> Column:
    """A line that is one record without quotes: its cells are simply what the delimiter parts."""
    return ~F.contains(text, F.lit('"')) & ~F.contains(_body(text), F.lit("\r"))


def _blank(body: Column, d: str) -> Column:
    return strip(F.replace(body, F.lit(d), F.lit(""))) == ""


def vote_delimiters(lines: DataFrame) -> DataFrame:
    """``(file_id, delimiter, field_count, consistency)`` of every file, from the widths of all its records."""
    alone = (F.col("before") == 0) & (F.col("after") == 0)

    def widths(text: Column, d: str) -> Column:
        body = _body(text)
        many = F.length(body) - F.length(F.replace(body, F.lit(d), F.lit(""))) + 1
        one = F.when(_blank(body, d), F.array().cast("array<int>")).otherwise(F.array(many))
        return F.when(_plain(text), one).otherwise(F.transform(records(text, d), F.size))

    by_k = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(DELIMITERS) - 1)))).select("file_id", "k", "block", "seq", "text", "end", *_state(F.col("k")))
    texts = by_k.where(alone).select("file_id", "k", "text").unionByName(joined_lines(by_k.where(~alone), ["file_id", "k"]).select("file_id", "k", "text"))
    each = F
    for k, d in DELIMITERS:
        each = each.when(F.col("k") == k, widths(F.col("text"), d))
    seen = texts.select("file_id", "k", F.explode(each).alias("width")).groupBy("file_id", "k", "width").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    modal = seen.groupBy("file_id", "k").agg(F.max(F.struct("hits", "width")).alias("modal"), F.sum("hits").alias("total"))
    vote = F
    for k, d in DELIMITERS:
        vote = vote.when(F.col("k") == k, modal_vote(F.col("modal"), F.col("total"), d, k))
    best = modal.groupBy("file_id").agg(F.max(vote).alias("best"))
    return best.select(
        "file_id",
        F.coalesce("best.delimiter", F.lit(rules.DEFAULT_DELIMITER)).alias("delimiter"),
        F.coalesce("best.width", F.lit(1)).alias("field_count"),
        F.coalesce("best.consistency", F.lit(0.0)).alias("consistency"),
    )


def split_records(lines: DataFrame, votes: DataFrame) -> DataFrame:
    """``(file_id, block, seq, part, cells, field_count)``: the records of every file in the order of the first three places."""
    k = F
    for i, d in DELIMITERS:
        k = k.when(F.col("delimiter") == d, F.lit(i))
    chosen = lines.join(votes.select("file_id", "delimiter", "field_count"), "file_id").withColumn("k", k)
    chosen = chosen.select("file_id", "delimiter", "field_count", "block", "seq", "text", "end", *_state(F.col("k")))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    texts = chosen.where(alone).select("file_id", "delimiter", "field_count", "block", "seq", "text")
    texts = texts.unionByName(joined_lines(chosen.where(~alone), ["file_id", "delimiter", "field_count"]))

    def cells(d: str) -> Column:
        body = _body(F.col("text"))
        one = F.when(_blank(body, d), F.array().cast("array<array<string>>")).otherwise(F.array(F.split(body, re.escape(d), -1)))
        return F.when(_plain(F.col("text")), one).otherwise(records(F.col("text"), d))

    found = by_delimiter(F.col("delimiter"), cells)
    return texts.select("file_id", "block", "seq", F.posexplode(found).alias("part", "cells"), "field_count")


def line_ends(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, line_ending)``: CRLF if any line feed follows a carriage return, else LF or CR.

    `files`: file_id, mode, and whether the last line ``ended`` (not known, and not asked for, in UTF-16).
    """
    place = F.struct("block", "seq")
    returned = F.col("text").endswith("\r")
    seen = lines.groupBy("file_id").agg(
        F.max("end").alias("end"), F.count(F.lit(1)).alias("lines"), F.count_if(returned).alias("returned"), F.max_by(returned, place).alias("last"), F.max(F.contains(F.col("text"), F.lit("\r"))).alias("any")
    )
    seen = seen.join(files.select("file_id", (F.col("ended") | F.col("mode").startswith("utf")).alias("ended")), "file_id")
    crlf = F.col("returned") > F.when(F.col("last") & ~F.col("ended"), 1).otherwise(0)
    ending = F.when(F.col("end") == "\r", "\r").when(crlf, "\r\n").when((F.col("lines") > 1) | F.col("ended") | ~F.col("any"), "\n").otherwise("\r")
    return seen.select("file_id", ending.alias("line_ending"))


def large_layout(spark: SparkSession, path: str, declared: str | None = None, over: int = rules.MAX_INPUT_BYTES, longest: int = LONGEST_LINE) -> Large:
    """Triage, layout and body rows of all files of more than `over` bytes below a path, read in splits."""
    judged = staged(triage_lines(spark, path, over, longest), "large-files")
    files = resolve_encoding(judged.where(F.col("kind") == "text"), declared, F.col("utf8")).drop("content")
    files = staged(files, "large-charsets")
    judged = judged.drop("content", "mode", "utf8", "marked", "ended")
    texts = _decoded(spark, path, files, over, longest)
    if texts is None:
        texts = spark.createDataFrame([], "file_id string, block bigint, seq bigint, text string, end string")
    lines = staged(line_states(texts), "lines")
    votes = staged(vote_delimiters(lines), "votes")
    found = staged(split_records(lines, votes), "records")

    # The first records as wide as the body, first of every range, then of the file.
    fitting = found.where(F.size("cells") == F.col("field_count"))
    for keys in (["file_id", "block"], ["file_id"]):
        first = F.row_number().over(W.partitionBy(*keys).orderBy("block", "seq", "part"))
        fitting = fitting.withColumn("__n", first).where(F.col("__n") <= rules.HEADER_CANDIDATES).drop("__n")
    place = F.struct("block", "seq", "part")
    tried = fitting.groupBy("file_id", "field_count").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "cells"))).alias("tried"))
    at = tried.withColumn("at", header_position(F.transform("tried", lambda t: t["cells"]), F.col("field_count")))
    header = F.when(F.col("at") >= 0, F.get("tried", F.col("at")))
    heads = at.select("file_id", header["place"].alias("header_place"), F.transform(header["cells"], strip).alias("named"))
    placed = found.join(heads.select("file_id", "header_place"), "file_id", "left")
    above = F.col("header_place").isNotNull() & (place < F.col("header_place"))
    body = (F.size("cells") == F.col("field_count")) & (F.col("header_place").isNull() | (place > F.col("header_place")))
    counts = placed.groupBy("file_id").agg(F.count_if(above).cast("int").alias("preamble_rows"), F.count_if(body).cast("int").alias("row_count"))
    rows = number_rows(placed.where(body).select("file_id", "block", "seq", "part", "cells"), ["file_id"], "block", ["seq", "part"], "source_row")

    numbered = F.transform(F.sequence(F.lit(1), F.col("field_count")), lambda i: F.concat(F.lit("Column "), i))
    laid = files.drop("mode", "utf8", "marked", "ended").join(line_ends(lines, files), "file_id", "left").join(votes, "file_id", "left").join(heads, "file_id", "left").join(counts, "file_id", "left")
    laid = laid.withColumns({"line_ending": F.coalesce("line_ending", F.lit("\n")), "delimiter": F.coalesce("delimiter", F.lit(rules.DEFAULT_DELIMITER)), "field_count": F.coalesce("field_count", F.lit(1)), "consistency": F.coalesce("consistency", F.lit(0.0))})
    laid = laid.withColumns(
        {
            "preamble_rows": F.coalesce("preamble_rows", F.lit(0)),
            "has_header": F.col("header_place").isNotNull(),
            "headers": F.coalesce("named", numbered),
            "row_count": F.coalesce("row_count", F.lit(0)),
        }
    )
    return Large(judged, laid.drop("named", "header_place"), rows.select("file_id", "source_row", "cells"))
