import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    """Make a documents table with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("score", "kept", "keep_id", "size", "copies", "class_id", "shard", "fp", "rate", "label"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
