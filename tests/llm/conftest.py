from __future__ import annotations

import pytest
from made_texts import prose
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use themselves, to see that they do not clash.
CLASHES = ["kept", "size", "bucket", "component_id", "ids", "score", "_trusted", "chunk", "held", "rep"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) or (doc_id, text, source) as a documents table."""

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in CLASHES if clash else []:
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """NULL ids and texts, empty, blank, very long, tied and repeated rows."""
    long = prose(1, 60_000)
    return [
        (None, prose(2, 40)), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, long), (5, long + " end"),
        (6, prose(3, 80)), (7, prose(3, 80)), (7, prose(3, 80)), (8, prose(3, 79) + " other"), (9, "one two"),
        (10, "ONE two"), (11, "éa ß \U0001f600 x" * 7), (12, prose(4, 300)),
    ]
