import pytest
from made import CLASHING
from pyspark.sql import functions as F, types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def session(spark):
    from ledgerline.llm.common import ready

    return ready(spark)


@pytest.fixture(scope="session")
def make_docs(session):
    def make(rows, clash=False):
        """Rows of (doc_id, text[, source])."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = session.createDataFrame(full, DOCS)
        if clash:
            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return make
