"""Layout without making cells: the same widths, triage at a look, landed batches on all cores."""

import random
import time

from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.functions.records import record_widths, records
from ledgerline.sources.landing import control_characters, triage


def test_widths_are_those_of_the_records(spark):
    rng = random.Random(4)
    pieces = ["a", "1", ",", ",", ";", "|", "\t", '"', '""', '"x,y"', '"p\nq"', '"', " ", " ", "\r\n", "\n", "\r", "^", "\n\n"]
    texts = ["", "\n", '""\n,', '"""",""\n', 'a,"b\r\nc",d\r\n'] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for d in rules.DELIMITERS:
        got = df.select("text", record_widths(F.col("text"), d).alias("w"), F.transform(records(F.col("text"), d), F.size).alias("r")).collect()
        assert [x for x in got if x.w != x.r] == []


def test_control_characters(spark):
    texts = ["", "a\tb\r\n", "\x01", "a\x0bb\x1f\x08", "\x0c\x7f\u0000", "\x0e" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.length(F.regexp_replace("t", r"[^\x01-\x08\x0b\x0e-\x1f]", ""))
    assert [r for r in df.select("t", control_characters(F.col("t")).alias("n"), plain.alias("p")).collect() if r.n != r.p] == []


def test_triage_of_a_long_text_is_quick(spark):
    content = b"01/02/2024,CARD 8841 GROCERY,-12.50\r\n" * 300_000
    df = spark.createDataFrame([("a", len(content), bytearray(content))], "file_id string, length long, content binary")
    triage(df).select("kind").collect()
    start = time.time()
    assert [r.kind for r in triage(df).select("kind").collect()] == ["text"]
    assert time.time() - start < 2.5


def test_landed_batches_are_dealt_to_all_cores(spark, monkeypatch, tmp_path):
    from ledgerline.plans import convert
    from ledgerline.streaming import jobs

    seen = []

    class Done(Exception):
        pass

    def stop(batch):
        seen.append(batch.rdd.getNumPartitions())
        raise Done

    monkeypatch.setattr(convert, "convert_files", stop)
    spark.range(50).withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    query = jobs.convert_landed_files(stream, f"{tmp_path}/checkpoint", f"{tmp_path}/out", available_now=True)
    try:
        query.awaitTermination()
    except Exception:
        pass
    assert seen[0] >= spark.sparkContext.defaultParallelism
