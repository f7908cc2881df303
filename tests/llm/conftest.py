import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text), with a column whose name clashes with results."""
    def build(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(list(rows), schema)
        return df.withColumns({c: F.lit("clash") for c in (
            "measures", "hits", "spans", "pieces", "n_words", "kept", "id", "key", "score", "gone", "probe")})

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
