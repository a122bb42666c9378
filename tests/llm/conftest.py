import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from {id: text} or from (id, text) rows, with columns whose names clash with inner ones."""

    def make(rows):
        rows = rows.items() if isinstance(rows, dict) else rows
        full = [(i, t, "en", None if n % 7 == 3 else f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        for name in ("id", "fp", "shard", "n", "key", "label", "block", "node", "size", "copy", "h"):
            df = df.withColumn(name, df["n_chars"])
        return df

    return make
