"""Small statement files through the whole path, and literal cases."""

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.convert import convert_files, to_documents
from ledgerline.sources.landing import scan_files
from ledgerline.sources.sinks import read_documents, write_documents

US = 'Date,Description,Amount,Balance\n01/03/2025,"BLUE BOTTLE COFFEE",-3.20,"1,246.80"\n01/17/2025,ACME PAYROLL,"$2,500.00","3,746.80"\n02/28/2025,ATM WITHDRAWAL,-100.00,"3,646.80"\n'
EU = "Date;Description;Debit;Credit;Balance\n17/01/2025;TESCO STORES;12,34;;1.234,56\n03/02/2025;SALARY PAYMENT;;2.500,00;3.734,56\n"
TABS = "Account Statement\r\nAccount: 1234\r\n\r\nTransaction Date\tNarration\tWithdrawal\tDeposit\r\n2025-01-05\tCAFÉ MOMENTO\t3.20\t\r\n2025-01-06\tINTEREST EARNED\t\t1.05\r\n"
LINES = 'Date,Description,Amount\n01/03/2025,"ACME CORP\nINVOICE 4471",-3.20\n01/17/2025,"MULTI\r\nLINE\r\nMERCHANT",2500.00\n02/28/2025,"TRAILING NEWLINE\n",-1.00\n'
PAREN = 'Date,Description,Amount\n01/03/2025,ALPHA,"(1,234.56)"\n01/17/2025,BRAVO,"2,500.00"\n02/28/2025,CHARLIE,"(99.99)"\n'
PAREN_EU = "Date;Description;Amount\n17/01/2025;ALPHA;(1.234,56)\n03/02/2025;BRAVO;2.500,00\n"
PAREN_SPACE = "Date;Description;Amount\n17/01/2025;ALPHA;(1 234,56)\n03/02/2025;BRAVO;2 500,00\n"
BOM = "Statement export\nAccount: 1234\n﻿Date,Description,Amount\n01/03/2025,COFFEE,-3.20\n01/17/2025,PAYROLL,2500.00\n"
MIXED = "Date,Description,Amount\n01/03/2025,LONDON OFFICE,£10.00\n01/17/2025,PARIS OFFICE,€20.00\n"
MIXED_COLUMN = "Date,Description,Amount,Currency\n01/03/2025,ALPHA,10.00,USD\n01/17/2025,BRAVO,20.00,EUR\n"
SAME = "Date,Description,Amount\n01/03/2025,A,$10.00\n01/17/2025,B,USD 20.00\n"
LATE = "Date,Description,Amount,Currency\n" + "".join(f"01/13/2025,ROW {i},-1.00,{'JPY' if i == 500 else 'USD'}\n" for i in range(600))
EMPTY_BODY = "Date,Description,Amount\n"
AMBIGUOUS = "Date,Description,Amount\n01/02/2025,ALPHA,-1.00\n03/04/2025,BRAVO,-2.00\n"

FILES = {
    "us": US.encode(), "us_bom": b"\xef\xbb\xbf" + US.encode(), "us_16le": b"\xff\xfe" + US.encode("utf-16le"), "us_16be": b"\xfe\xff" + US.encode("utf-16be"),
    "eu": EU.encode(), "tabs": TABS.encode("cp1252"), "lines": LINES.encode(), "paren": PAREN.encode(), "paren_eu": PAREN_EU.encode(), "paren_space": PAREN_SPACE.encode(),
    "bom": BOM.encode(), "mixed": MIXED.encode(), "mixed_column": MIXED_COLUMN.encode(), "same": SAME.encode(), "late": LATE.encode(),
    "empty_body": EMPTY_BODY.encode(), "ambiguous": AMBIGUOUS.encode(), "pdf": b"%PDF-1.7\n\xe2\xe3", "nul": b"Date,Desc" + b"\0" * 90, "nothing": b"",
    "noise": bytes((i * 7919 + 13) % 31 + 1 for i in range(4000)),
}

STATEMENT = """OFXHEADER:100
DATA:OFXSGML
VERSION:102
SECURITY:NONE
ENCODING:USASCII
CHARSET:1252
COMPRESSION:NONE
OLDFILEUID:NONE
NEWFILEUID:C2D47E14FBE92458E3E96776E454C1C1

<OFX>
  <SIGNONMSGSRSV1>
    <SONRS>
      <STATUS>
        <CODE>0
        <SEVERITY>INFO
      </STATUS>
      <DTSERVER>20250228000000[-5:EST]
      <LANGUAGE>ENG
      <FI>
        <ORG>Example Bank
        <FID>10898
      </FI>
      <INTU.BID>10898
    </SONRS>
  </SIGNONMSGSRSV1>
  <BANKMSGSRSV1>
    <STMTTRNRS>
      <TRNUID>1
      <STATUS>
        <CODE>0
        <SEVERITY>INFO
      </STATUS>
      <STMTRS>
        <CURDEF>USD
        <BANKACCTFROM>
          <BANKID>021000021
          <ACCTID>000123456789
          <ACCTTYPE>CHECKING
        </BANKACCTFROM>
        <BANKTRANLIST>
          <DTSTART>20250103
          <DTEND>20250228
          <STMTTRN>
            <TRNTYPE>DEBIT
            <DTPOSTED>20250103
            <TRNAMT>-3.20
            <FITID>3838421E93E86E928E4F5E69095E6400
            <NAME>BLUE BOTTLE COFFEE
          </STMTTRN>
          <STMTTRN>
            <TRNTYPE>DIRECTDEP
            <DTPOSTED>20250117
            <TRNAMT>2500.00
            <FITID>16DA676E4FA26CF2C73D2558F968CF87
            <NAME>ACME PAYROLL
          </STMTTRN>
          <STMTTRN>
            <TRNTYPE>ATM
            <DTPOSTED>20250228
            <TRNAMT>-100.00
            <FITID>8888EFDCDF3D27E4E1A3D237F2EB5D8A
            <NAME>ATM WITHDRAWAL
          </STMTTRN>
        </BANKTRANLIST>
        <LEDGERBAL>
          <BALAMT>3646.80
          <DTASOF>20250228000000[-5:EST]
        </LEDGERBAL>
      </STMTRS>
    </STMTTRNRS>
  </BANKMSGSRSV1>
</OFX>
"""


@pytest.fixture(scope="module")
def converted(spark):
    files = spark.createDataFrame([(n, f"{n}.csv", len(b), bytearray(b)) for n, b in FILES.items()], "file_id string, file_name string, length bigint, content binary")
    accounts = files.select(
        "file_id", F.lit("000123456789").alias("account_id"), F.lit("021000021").alias("bank_id"), F.lit("Example Bank").alias("institution"),
        F.lit("10898").alias("fid"), F.when(F.col("file_id").isin("eu", "paren_eu"), "EUR").otherwise("USD").alias("currency"),
        F.when(F.col("file_id").isin("eu", "paren_eu"), "[0:GMT]").otherwise("[-5:EST]").alias("time_zone_suffix"),
    )
    inspection, conversion = convert_files(files, accounts)
    rows = conversion.transactions.orderBy("file_id", "source_row").collect()
    return {
        "rows": {n: [r for r in rows if r.file_id == n] for n in FILES},
        "issues": {n: [(r.code, r.level, r.column, r.message) for r in conversion.issues.filter(F.col("file_id") == n).collect()] for n in ("mixed", "mixed_column", "same", "late", "empty_body", "ambiguous", "pdf", "nul", "nothing", "noise", "tabs")},
        "outcomes": {r.file_id: (r.outcome, r.failure_code) for r in conversion.outcomes.collect()},
        "uids": {r.file_id: r.uid for r in conversion.statements.collect()},
        "documents": {r.file_id: r.text for r in to_documents(conversion, "qbo").collect()},
        "roles": {r.file_id: r.roles for r in inspection.mapping.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "role"))), lambda x: x["role"]).alias("roles")).collect()},
    }


@pytest.mark.parametrize(
    "name, amounts",
    [("us", [-320, 250000, -10000]), ("us_bom", [-320, 250000, -10000]), ("us_16le", [-320, 250000, -10000]), ("us_16be", [-320, 250000, -10000]), ("eu", [-1234, 250000]),
     ("tabs", [-320, 105]), ("lines", [-320, 250000, -100]), ("paren", [-123456, 250000, -9999]), ("paren_eu", [-123456, 250000]), ("paren_space", [-123456, 250000]), ("bom", [-320, 250000])],
)
def test_amounts(converted, name, amounts):
    assert [int(r.amount_minor) for r in converted["rows"][name]] == amounts


@pytest.mark.parametrize(
    "name, uid",
    [("us", "C2D47E14FBE92458E3E96776E454C1C1"), ("us_16le", "C2D47E14FBE92458E3E96776E454C1C1"), ("eu", "F8376D5B6A77E13506A7C9357AD4D6C7"), ("paren", "3138974A7A04E5E0FA7D86081BB58E0F"),
     ("paren_eu", "2C7650A00CBB189FE9D25D41534DD893"), ("lines", "1814B32D1AD5E9F10696A8C09B0A2509")],
)
def test_statement_uids(converted, name, uid):
    assert converted["uids"][name] == uid


def test_document_is_exact(converted):
    assert converted["documents"]["us"] == STATEMENT.replace("\n", "\r\n")
    assert "<NAME>ACME CORP INVOICE 4471\r\n" in converted["documents"]["lines"]


def test_details(converted):
    assert [r.date_posted.isoformat() for r in converted["rows"]["eu"]] == ["2025-01-17", "2025-02-03"]
    assert [r.type for r in converted["rows"]["us"]] == ["DEBIT", "DIRECTDEP", "ATM"]
    assert "CAFÉ" in converted["rows"]["tabs"][0].name
    assert converted["roles"]["tabs"] == ["date", "description", "debit", "credit"]
    assert converted["roles"]["eu"] == ["date", "description", "debit", "credit", "balance"]


@pytest.mark.parametrize(
    "name, code",
    [("mixed", "multi-currency"), ("mixed_column", "multi-currency"), ("late", "multi-currency"), ("empty_body", "no-rows"), ("pdf", "unsupported-content"),
     ("nul", "unsupported-content"), ("nothing", "empty-file"), ("noise", "unsupported-content")],
)
def test_failures(converted, name, code):
    assert converted["outcomes"][name] == ("failed", code)
    assert code in [i[0] for i in converted["issues"][name]]


def test_warnings(converted):
    assert "ambiguous-date-order" in [i[0] for i in converted["issues"]["ambiguous"]]
    assert "encoding-fallback" in [i[0] for i in converted["issues"]["tabs"]]
    assert converted["outcomes"]["same"][0] == "converted"
    assert converted["issues"]["mixed_column"][0][2] == 3
    assert "JPY" in converted["issues"]["late"][0][3]


# --- from a folder of files to a folder of documents ---------------------------

# Evidence that stands late: after row 200 for dates, separators and currencies, after record 40 for the header and the layout.
LATE_DATES = "Date,Description,Amount\n" + "".join(f"{i % 12 + 1:02d}/{i % 12 + 1:02d}/2025,ROW {i},-1.00\n" for i in range(300)) + "17/01/2025,LAST,-2.00\n"
LATE_COMMAS = "Date;Description;Amount\n" + "".join(f"2025-01-05;ROW {i};1000\n" for i in range(300)) + "2025-01-06;LAST;1.234,56\n"
LONG_PREAMBLE = "".join(f"Note {i}\n" for i in range(60)) + "Date,Description,Amount\n" + "01/13/2025,ALPHA,-1.00\n01/14/2025,BRAVO,-2.00\n" * 50


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    zone = tmp_path_factory.mktemp("zone")
    made = {"My Bank (2024).csv": US, "sub/My Bank (2024).csv": PAREN, "late_dates.csv": LATE_DATES, "late_commas.csv": LATE_COMMAS, "preamble.csv": LONG_PREAMBLE}
    for name, text in made.items():
        (zone / name).parent.mkdir(exist_ok=True)
        (zone / name).write_bytes(text.encode())
    (zone / "late_nul.csv").write_bytes(US.encode() + b"x" * 6000 + b"\0")
    (zone / "picture.png").write_bytes(b"png")
    files = scan_files(spark, str(zone))
    inspection, conversion = convert_files(files)
    return files, inspection, conversion


def test_scan_finds_the_exports(landed):
    files, _, conversion = landed
    assert sorted(r.file_name for r in files.collect()) == sorted(["My Bank (2024).csv"] * 2 + ["late_dates.csv", "late_commas.csv", "preamble.csv", "late_nul.csv"])
    codes = {r.file_id.rsplit("/", 1)[-1]: r.failure_code for r in conversion.outcomes.collect()}
    assert codes["late_nul.csv"] == "unsupported-content" and codes["preamble.csv"] is None


def test_accounts_are_base_names(landed):
    assert {r.account_id for r in landed[2].statements.collect()} == {"My Bank (2024)", "late_dates", "late_commas", "preamble"}


def test_late_evidence_decides(landed):
    _, inspection, conversion = landed
    profile = {r.file_id.rsplit("/", 1)[-1]: r for r in inspection.profile.collect()}
    assert profile["late_dates.csv"].date_order == "DMY" and profile["late_commas.csv"].decimal_separator == ","
    rows = conversion.transactions.filter(F.col("file_id").endswith("late_dates.csv")).collect()
    assert len(rows) == 301 and max(r.date_posted for r in rows).isoformat() == "2025-12-12"
    assert conversion.transactions.filter(F.col("file_id").endswith("preamble.csv")).count() == 100


def test_documents_are_written_under_their_names(spark, landed, tmp_path):
    files, _, conversion = landed
    parts = to_documents(conversion, "ofx")
    path = str(tmp_path / "out")
    write_documents(parts.filter(F.col("file_id").contains("My")), files, path)
    write_documents(parts.filter(~F.col("file_id").contains("My")), files, path)  # a second batch leaves the first one alone
    lines = read_documents(spark, path)
    assert {r.document for r in lines.select("document").collect()} == {"my_bank_2024_converted.ofx", "late_dates_converted.ofx", "late_commas_converted.ofx", "preamble_converted.ofx"}
    whole = lines.groupBy("document", "file_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\r\n").alias("text"))
    wanted = {r.k: r.text for r in parts.select(F.md5("file_id").alias("k"), "text").collect()}
    assert {r.file_key: r.text + "\r\n" for r in whole.collect()} == wanted


def test_overrides_reach_the_transactions(spark):
    text = "Date,Description,Value\n01/13/2025,ALPHA,1.00\n01/14/2025,BRAVO,2.50\n"
    files = spark.createDataFrame([("f", "f.csv", len(text), bytearray(text.encode()))], "file_id string, file_name string, length bigint, content binary")
    inverted = spark.createDataFrame([("f", "signed-inverted")], "file_id string, convention string")
    assert [int(r.amount_minor) for r in convert_files(files, conventions=inverted)[1].transactions.orderBy("source_row").collect()] == [-100, -250]
    as_memo = spark.createDataFrame([("f", 1, "memo")], "file_id string, col_index int, role string")
    rows = convert_files(files, overrides=as_memo)[1].transactions.orderBy("source_row").collect()
    assert [(r.name, r.memo) for r in rows] == [("ALPHA", "ALPHA"), ("BRAVO", "BRAVO")]


def test_first_error_counts_and_empty_files_say_so(spark):
    from ledgerline.operators.normalize import empty_file_issues, file_outcomes

    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_id string")
    issues = spark.createDataFrame([("a", 4, "error", "no-date-column"), ("a", 7, "error", "no-amount-column"), ("a", 8, "error", "multi-currency")], "file_id string, ordinal int, level string, code string")
    outcomes = file_outcomes(files, spark.createDataFrame([("c", 3)], "file_id string, accepted_rows long"), issues)
    assert {r.file_id: r.failure_code for r in outcomes.collect()} == {"a": "no-date-column", "b": "no-transactions", "c": None}
    assert [(r.file_id, r.code) for r in empty_file_issues(outcomes).collect()] == [("b", "no-transactions")]
