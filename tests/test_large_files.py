"""Files read in splits against the same files read whole."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_files import FILES

from ledgerline import rules
from ledgerline.functions.records import records
from ledgerline.plans.convert import convert_folder
from ledgerline.sources import large

HEADS = ["kind", "format", "reject_code", "bom", "encoding", "fallback", "line_ending", "delimiter", "field_count", "consistency", "preamble_rows", "has_header", "headers", "row_count"]


@pytest.fixture(scope="module")
def small_splits(spark):
    """Ranges of a few dozen bytes, so that cells, quotes and line ends are cut everywhere."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _quoted(seed):
    """Records with line ends, delimiters and doubled quotes in quoted cells, and stray quotes in plain ones."""
    rng = random.Random(seed)
    cell = ["ALPHA", '"B, C"', '"LINE\nTWO"', '"A ""Q"" B"', '5" PIPE', '"\r\nX\r\n\r\n"', '""', '"; | ;"', 'END"', '"A"TAIL']
    lines = [f"01/{rng.randint(13, 28)}/2025,{rng.choice(cell)},-{rng.randint(1, 99)}.00,{rng.choice(cell)}" for _ in range(40)]
    return "Date,Description,Amount,Memo\n" + "\n".join(lines) + "\n"


MADE = {
    **{f"quoted {k}+%": _quoted(k).encode() for k in range(3)},
    "open_quote": ("Date,Description,Amount\n01/13/2025,A,-1.00\n01/14/2025,\"NEVER CLOSED,-2.00\n01/15/2025,B,-3.00\n01/16/2025,\"\",-4.00\n01/17/2025,C,-5.00\n").encode(),
    "returns": "Date,Description,Amount\r01/13/2025,A,-1.00\r01/14/2025,\"B\rB\",-2.00\r01/15/2025,C,-3.00\r".encode(),
    "crlf": "Date;Description;Amount\r\n13/01/2025;\"A\r\n\r\nB\";-1,00\r\n14/01/2025;C;-2,00\r\n".encode(),
    "blank_lines": "\n\n ,, \nDate,Description,Amount\n\n01/13/2025,A,-1.00\n,,\n\n01/14/2025,B,-2.00".encode(),
    "headerless": "01/13/2025,A,-1.00\n01/14/2025,B,-2.00\n01/15/2025,\"C\nC\",-3.00\n".encode(),
    "wide_be": b"\xfe\xff" + "Date,Description,Amount\n01/13/2025,\"CAFÉ\nX\",-1.00\n01/14/2025,Ċਊ,-2.00\n".encode("utf-16be"),
}


@pytest.fixture(scope="module")
def both(small_splits, tmp_path_factory):
    zone = tmp_path_factory.mktemp("zone")
    for name, content in {**FILES, **MADE}.items():
        (zone / f"{name}.csv").write_bytes(content)
    return [convert_folder(small_splits, str(zone), whole_bytes=n) for n in (rules.MAX_INPUT_BYTES, 0)]


def _same(frames, columns, order):
    whole, split = (sorted(map(repr, df.select(*columns).collect())) if order is None else [tuple(r) for r in df.select(*columns).orderBy(*order).collect()] for df in frames)
    differ = sorted(set(map(repr, whole)) ^ set(map(repr, split)))
    assert not differ, "\n".join(differ)
    assert len(whole) == len(split)


def test_same_layout(both):
    _same([x[0].files for x in both], ["file_id", "file_name", "length", *[c for c in HEADS if c != "reject_code"]], ["file_id"])


def test_same_rows(both):
    _same([x[0].rows for x in both], ["file_id", "source_row", "cells"], ["file_id", "source_row"])


def test_same_transactions_and_ids(both):
    _same([x[1].transactions for x in both], ["file_id", "source_row", "date_posted", "amount_minor", "name", "memo", "fit_id"], ["file_id", "source_row"])


def test_same_issues_and_statements(both):
    _same([x[1].issues for x in both], ["file_id", "code", "level", "message", "row"], None)
    _same([x[1].statements for x in both], [c for c in both[0][1].statements.columns], None)


def test_lines_know_whether_they_begin_in_a_cell(spark):
    """States of random lines in random ranges against the pattern over the whole text."""
    rng = random.Random(5)
    texts = {}
    for t in range(40):
        lines = ["".join(rng.choice(['"', '"', ",", ";", "a", " ", "\r"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))]
        texts[str(t)] = lines
    rows = []
    for t, lines in texts.items():
        cuts = sorted(rng.sample(range(1, len(lines) + 1), min(3, len(lines))))
        rows += [(t, sum(i >= c for c in cuts), i, line, "\n") for i, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "file_id string, block bigint, seq bigint, text string, end string")
    states = large.line_states(frame)
    for d in (",", ";"):
        votes = spark.createDataFrame([(t, d, 1) for t in texts], "file_id string, delimiter string, field_count int")
        got = large.split_records(states, votes).orderBy("file_id", "block", "seq", "part").collect()
        whole = spark.createDataFrame([(t, "\n".join(lines)) for t, lines in texts.items()], "file_id string, text string").select("file_id", records(F.col("text"), d).alias("r"))
        for r in whole.collect():
            assert [list(g.cells) for g in got if g.file_id == r.file_id] == [list(c) for c in r.r], (d, texts[r.file_id])


def test_a_line_too_long_is_refused_not_cut(small_splits, tmp_path):
    (tmp_path / "long.csv").write_bytes(b"Date,Description,Amount\n01/13/2025," + b"x" * 5000 + b",-1.00\n")
    (tmp_path / "fine.csv").write_bytes(b"Date,Description,Amount\n01/13/2025,A,-1.00\n")
    found = large.large_layout(small_splits, str(tmp_path), over=0, longest=1000)
    assert {re.split("[/.]", r.file_id)[-2]: r.reject_code for r in found.judged.collect()} == {"long": "line-too-long", "fine": None}
    assert [r.file_id[-8:] for r in found.rows.collect()] == ["fine.csv"]


def test_every_range_is_read_by_its_own_task(small_splits, tmp_path):
    (tmp_path / "one.csv").write_text("Date,Description,Amount\n" + "01/13/2025,ALPHA,-1.00\n" * 50)
    lines = large.scan_lines(small_splits, str(tmp_path), over=0)
    assert lines.rdd.getNumPartitions() > 10 and lines.count() == 51
    assert large.scan_lines(small_splits, str(tmp_path)).count() == 0
