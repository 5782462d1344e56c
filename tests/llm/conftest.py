import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """documents rows from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("id", "key", "size", "score", "node", "label", "set", "start", "end", "taken", "rank", "Root", "a"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
