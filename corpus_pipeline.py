"""A corpus through five of the operators: toxicity, near copies, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import jaccard, mixing, packing, secrets, toxicity
from ledgerline.llm.common import ready
from ledgerline.llm.near import SENT_IDS
from ledgerline.session import staged
from ledgerline.sources.tables import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of the operator; all columns as they were."""
    ready(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, score_column="__score", spans_column="__spans")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without an id and texts without words are groups of their own. Rows that
    repeat an id and its text are copies, too.
    """
    ready(spark)
    found = staged(jaccard.near_duplicates(docs), "groups")
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    stay = docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = staged(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return stay
    sent = F.broadcast(repeated) if repeated.count() <= SENT_IDS else repeated
    once = stay.join(sent, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return stay.join(sent, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a marker and n_chars brought up to date."""
    ready(spark)
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows the mix takes, as often as it takes them; one document a source may be cut where the target falls."""
    ready(spark)
    out = mixing.mixed_rows(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row a piece."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("secret_scans", without_secrets),
    ("mix_sources", mixed),
    ("sum_of_squares_packing", packed),
]

# The first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read back."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
