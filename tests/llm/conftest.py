import pytest
from pyspark.sql import types as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, source[, lang]]) to a table like ``documents``."""

    def build(rows, extra=""):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", None) for r in rows]
        schema = T._parse_datatype_string(DOC)
        df = spark.createDataFrame(full, schema)
        for name in extra.split():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(name))
        return df

    return build


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
