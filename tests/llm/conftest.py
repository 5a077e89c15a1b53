import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, extra=True):
        full = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("key", "id", "n", "class", "bucket", "blob", "kept", "path", "plain", "host"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make
