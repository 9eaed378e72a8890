"""One named file per statement."""

import os

import pytest

from ledgerline.sources import documents as docs

PARTS = "file_id string, dialect string, part bigint, parts bigint, text string"


@pytest.fixture
def made(spark):
    rows = [(f"f{k}", "qbo" if k % 2 else "ofx", p, 4, f"file {k} part {p} é\r\n" * (50 if k == 3 else 1)) for k in range(6) for p in range(4 if k != 3 else 200)]
    files = spark.createDataFrame([(f"f{k}", "My Bank.csv" if k < 2 else f"bank_{k}.csv") for k in range(6)], "file_id string, file_name string")
    return spark.createDataFrame(rows, PARTS).repartition(7), files, rows


def _read(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")}


def test_each_statement_is_one_file_of_its_parts_in_order(spark, made, tmp_path):
    parts, files, rows = made
    path = str(tmp_path / "out")
    docs.write_statement_files(parts, files, path)
    found = _read(path)
    want = {}
    for f, dialect, p, _, text in sorted(rows, key=lambda r: (r[0], r[2])):
        want.setdefault((f, dialect), b"")
        want[f, dialect] += text.encode()
    assert sorted(found.values()) == sorted(want.values()) and len(found) == 6
    assert {os.path.basename(n) for n in found} >= {"my_bank_converted.ofx", "my_bank_converted.qbo", "bank_3_converted.qbo"}
    # Written again with one statement changed: that file is replaced, the others stay.
    docs.write_statement_files(spark.createDataFrame([("f2", "ofx", 0, 1, "new\r\n")], PARTS), files, path)
    again = _read(path)
    assert sum(again[n] != found[n] for n in found) == 1 and b"new\r\n" in again.values() and len(again) == 6


def test_a_failed_or_repeated_task_leaves_nothing_behind(tmp_path):
    from pyspark.sql import Row

    writer = docs.StatementWriter(str(tmp_path))
    rows = [Row(folder="ofx/k", document="a.ofx", part=p, text=f"{p}\r\n") for p in range(3)]

    def broken():
        yield rows[0]
        raise ValueError("lost")

    with pytest.raises(ValueError):
        writer.write(broken())
    assert _read(tmp_path) == {}
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([second, None, writer.write(iter(()))])
    assert _read(tmp_path)["ofx/k/a.ofx"] == b"0\r\n1\r\n2\r\n"
    writer.abort([first])
    assert list(_read(tmp_path)) == ["ofx/k/a.ofx"]


def _moved(spark, rows):
    """Transactions with what the markup looks at, from (file_id, source_row)."""
    df = spark.createDataFrame(rows, "file_id string, source_row bigint")
    return df.selectExpr(
        "*", "'DEBIT' AS type", "DATE'2024-01-05' AS date_posted", "CAST(NULL AS int) AS time_seconds", "CAST(NULL AS date) AS date_user", "CAST(-150 AS decimal(38,0)) AS amount_minor", "2 AS scale",
        "concat(file_id, '-', source_row) AS fit_id", "CAST(NULL AS string) AS check_number", "'' AS reference_number", "IF(source_row % 2 = 0, ' A & B ', '') AS name", "'note' AS memo", "CAST(source_row AS decimal(38,0)) AS balance_minor",
    )


def test_texts_meet_their_frames_without_a_join(spark):
    from pyspark.sql import functions as F

    from ledgerline import rules
    from ledgerline.operators.statements import documents, statements

    moved = _moved(spark, [("a", r) for r in (0, 1, 2, 3, 9)] + [("b", 7)])
    accounts = spark.createDataFrame([("a",), ("b",), ("empty",)], "file_id string").select("file_id", F.col("file_id").alias("account_id"), *[F.lit(v).alias(k) for k, v in rules.ACCOUNT_DEFAULTS.items()])
    rows = statements(moved, accounts, rows_per_part=2)
    both = rows.crossJoin(spark.createDataFrame([("ofx",), ("qbo",)], "kind string"))
    made = documents(moved, both, F.col("kind"), rows_per_part=2)
    found = {(r.file_id, r.dialect, r.part): r for r in made.collect()}
    # Rows 4 to 8 of the first file were refused: its parts 2 and 3 hold nothing.
    assert sorted(k[::2] for k in found if k[1] == "qbo") == [("a", 0), ("a", 1), ("a", 4), ("b", 3), ("empty", 0)] and len(found) == 10
    assert {r.parts for k, r in found.items() if k[0] == "a"} == {5}
    for file, n in (("a", 5), ("b", 1), ("empty", 0)):
        text = "".join(found[k].text for k in sorted(found) if k[:2] == (file, "qbo"))
        assert text.startswith("OFXHEADER:100\r\n") and text.endswith("</OFX>\r\n") and text.count("<STMTTRN>") == text.count("<OFX>") * n and "\r\n\r\n<STM" not in text
        assert text.count("<NAME>A &amp; B\r\n") == {"a": 2, "b": 0, "empty": 0}[file] and text.count("<NAME>DEBIT\r\n") == {"a": 3, "b": 1, "empty": 0}[file]
    # Above the aggregation that makes the parts there is no join, which would carry every text to one side's few tasks.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("collect_list", 1)[0]


def test_identifiers_keep_ascii_word_characters_only(spark):
    import re

    from pyspark.sql import functions as F

    from ledgerline.functions.text import id_token

    values = ["ABC-1.x_9", "", "a b", "é1", "1٣x", "ß-K", "a\nb", "x" * 40, "#" * 30 + "y", "á"]
    found = {r.v: r.t for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", id_token(F.col("v"), 22).alias("t")).collect()}
    assert found == {v: re.sub("[^A-Za-z0-9._-]", "", v)[:22] for v in values}
    # Lists of lines are made once, behind the shuffle: a partial one before it would hold few lines each.
    plan = _plan_of_documents(spark)
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(file_id")


def _plan_of_documents(spark):
    from pyspark.sql import functions as F

    from ledgerline import rules
    from ledgerline.operators.statements import documents, statements

    moved = _moved(spark, [("a", 0)])
    accounts = spark.createDataFrame([("a",)], "file_id string").select("file_id", F.col("file_id").alias("account_id"), *[F.lit(v).alias(k) for k, v in rules.ACCOUNT_DEFAULTS.items()])
    return documents(moved, statements(moved, accounts), "ofx")._jdf.queryExecution().executedPlan().toString()


def test_documents_of_several_parts_are_whole(spark, tmp_path):
    import compare
    import duckdb

    import __spark_entry__ as entry
    from ledgerline import catalog

    con = duckdb.connect()
    # Two statements of three and two parts, one of a single part, one of exactly a part.
    made = """SELECT i AS o_orderkey, CASE WHEN i < 40010 THEN 1 WHEN i < 60011 THEN 41 WHEN i < 60100 THEN 81 ELSE 121 END::BIGINT AS o_custkey, CASE WHEN i % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
        (i % 9973) * 1.25 + 0.01 AS o_totalprice, TIMESTAMP '1995-01-01' + to_days(CAST(i % 1500 AS INTEGER)) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(80100) t(i)"""
    con.execute(f"COPY ({made}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = entry.queries()["s07_documents"](spark, str(tmp_path))
    assert compare.difference(found, con, catalog.ORACLES["s07_documents"]) is None
    assert sorted(r.blocks for r in found.collect()) == [89, 20_000, 20_001, 40_010]


def test_parts_of_a_file_are_digested_in_order(spark):
    import hashlib

    from pyspark.sql import functions as F

    rows = [(f"f{k}" if k else None, p, n, 2, f"file {k} part {p} é\r\n" * (1 + p)) for k, n in enumerate((5, 1, 300, 1, 2)) for p in range(n)]
    parts = spark.createDataFrame(rows, "file_id string, part bigint, parts bigint, blocks bigint, text string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = sorted(map(tuple, docs.digests_of_files(parts).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {}
    for f, _, _, _, text in rows:
        whole[f] = whole.get(f, "") + text
    assert found == sorted(((f, 2 * sum(r[0] == f for r in rows), hashlib.md5(t.encode()).hexdigest()) for f, t in whole.items()), key=repr)
    assert docs.digests_of_files(parts.where(F.lit(False))).count() == 0
