import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def documents(spark):
    """documents rows from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text, *rest = r
            lang, source = (list(rest) + [None, None])[:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOC_SCHEMA)
    return make
