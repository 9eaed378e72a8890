"""The landing zone: export files as bytes, triaged and decoded.

A file is one row of at most 128 MiB here, so everything up to the exploded cells
is a narrow projection: no shuffle happens before rows exist. Larger files are
read in splits (`sources.large`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline import rules
from ledgerline.functions.staged import pin

FILE = ["file_id", "file_name", "length", "content"]


def scan_files(spark: SparkSession, path: str, most: int = rules.MAX_INPUT_BYTES) -> DataFrame:
    """Every accepted export below a path: ``(file_id, file_name, length, content)``.

    The size test is pushed to the source, so a file of more than `most` bytes is
    listed with NULL content and its bytes are never read.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", rules.ACCEPTED_GLOB)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    fits = raw.filter(F.col("length") <= most).select("path", "length", "content")
    over = raw.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return fits.unionByName(over).select(F.col("path").alias("file_id"), name.alias("file_name"), "length", "content")


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def _starts(hex_text: str) -> Column:
    return F.substring("content", 1, len(hex_text) // 2) == _bytes(hex_text)


def control_characters(text: Column) -> Column:
    """How many control characters a text holds; most hold none, and one look tells."""
    controls = "".join(map(chr, [*range(1, 9), 11, *range(14, 32)]))
    held = F.length(text) - F.length(F.translate(text, controls, ""))
    return F.when(text.rlike(r"[\x01-\x08\x0b\x0e-\x1f]"), held).otherwise(F.lit(0))


def triage(files: DataFrame) -> DataFrame:
    """Classify files by their whole content: ``kind``, ``format`` and the fatal ``reject_code``/``reject_message``."""
    sample = F.decode("content", "ISO-8859-1")
    seen = files.withColumns(
        {
            "__nul": F.contains(sample, F.lit("\u0000")),
            "__control": control_characters(sample) / F.greatest(F.col("length"), F.lit(1)),
        }
    )
    return judge(seen)


def judge(seen: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The decision from the first bytes (``content``), ``length``, ``__nul`` and the share ``__control``."""
    signature = F
    for prefix, name in rules.SIGNATURES:
        signature = signature.when(_starts(prefix), F.lit(name))
    wide = _starts("FFFE") | _starts("FEFF")
    noisy = F.col("__control") > rules.CONTROL_SHARE_LIMIT
    known = seen.withColumn("format", F.when(F.col("length") > 0, signature))
    kind = (
        F.when(F.col("content").isNull(), "too large")
        .when(F.col("length") == 0, "empty")
        .when(F.col("format").isNotNull(), "binary")
        .when(wide, "text")
        .when(F.col("__nul") | noisy, "binary")
        .otherwise("text")
    )
    judged = known.withColumn("kind", kind)

    def whole(x: Column) -> Column:
        return F.floor(x + 0.5).cast("string")

    limit = str(rules.MAX_INPUT_BYTES // 1024 // 1024)
    message = (
        F.when(F.col("kind") == "too large", F.concat(F.lit("The file is "), whole(F.col("length") / 1024 / 1024), F.lit(f" MB; the limit is {limit} MB.")))
        .when(F.col("kind") == "empty", "The file is empty.")
        .when(F.col("format").isNotNull(), F.concat(F.lit("The file looks like a "), F.col("format"), F.lit(", not a CSV or text export.")))
        .when(F.col("__nul"), "The file contains NUL bytes, so it is not a text export.")
        .otherwise(F.concat(whole(F.col("__control") * 100), F.lit("% of the bytes are control characters, so this is not a text export.")))
    )
    code = F.when(F.col("kind") == "too large", "file-too-large").when(F.col("kind") == "empty", "empty-file").when(F.col("kind") == "binary", "unsupported-content")
    return pin(
        judged,
        {"format": F.col("format"), "kind": F.col("kind"), "reject_code": code, "reject_message": F.when(code.isNotNull(), message)} | {c: F.col(c) for c in keep},
        drop=("__nul", "__control"),
    )


def resolve_encoding(files: DataFrame, declared: str | None = None, valid: Column | None = None) -> DataFrame:
    """Add ``encoding``, ``detected_label``, ``confidence``, ``bom``, ``bom_length``, ``fallback``.

    A byte order mark wins, then a declared charset (column name), then valid
    UTF-8; anything else is read as windows-1252 and flagged. ``valid`` says
    whether the file is valid UTF-8 where ``content`` holds its beginning only.
    """
    fallback = rules.FALLBACK_CHARSET[0]
    bom, bom_length, supported = F, F, F
    for prefix, name, charset in rules.BYTE_ORDER_MARKS:
        bom = bom.when(_starts(prefix), F.lit(name))
        bom_length = bom_length.when(_starts(prefix), F.lit(len(prefix) // 2 if charset else 0))
        supported = supported.when(_starts(prefix), F.lit(name if charset else fallback))
    marked = files.withColumns({"bom": bom.otherwise(F.lit(None)), "bom_length": bom_length.otherwise(F.lit(0))})
    label = F.lower(F.trim(F.col(declared))) if declared else F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for k, v in rules.CHARSETS.items() for x in (k, v[0])])
    stated = F.try_element_at(names, F.coalesce(label, F.lit("")))
    utf8 = F.is_valid_utf8(F.col("content").cast("string")) if valid is None else valid
    encoding = supported.when(stated.isNotNull(), stated).when(utf8, F.lit("utf-8")).otherwise(F.lit(fallback))
    unsupported = F.col("bom").isin("utf-32le", "utf-32be")
    guessed = F.col("bom").isNull() & stated.isNull() & ~utf8
    return pin(
        marked,
        {
            "bom": F.col("bom"),
            "bom_length": F.col("bom_length"),
            "encoding": encoding,
            "detected_label": F.coalesce("bom", F.when(stated.isNotNull(), label), F.when(utf8, F.lit("utf-8"))),
            "fallback": F.coalesce(unsupported, F.lit(False)) | guessed,
            "confidence": F.when(F.coalesce(unsupported, F.lit(False)) | guessed, F.lit(0.0)).otherwise(F.lit(1.0)),
        },
    )


def decode_files(files: DataFrame, declared: str | None = None) -> DataFrame:
    """Text files with ``text``; the byte order mark is gone, bad bytes are U+FFFD."""
    body = F.expr("substring(content, bom_length + 1, length(content))")
    charsets = dict(rules.CHARSETS.values()) | dict([rules.FALLBACK_CHARSET])
    text = F
    for name, java in charsets.items():
        text = text.when(F.col("encoding") == name, F.decode(body, java))
    return pin(resolve_encoding(files, declared), {"text": text}, drop=("content",))
