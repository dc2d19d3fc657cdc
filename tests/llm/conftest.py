import pytest
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
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A function from rows (doc_id, text[, source]) to a table of documents."""

    def build(rows, **extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def table(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")
