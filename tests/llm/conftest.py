import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Documents from texts, with the columns of the given table; sources and languages in turn."""

    def make(texts, ids=None, sources=None, langs=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, langs[k] if langs else ["en", "fr"][k % 2], sources[k] if sources else f"s{k % 3}", len(t or ""))
                for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        for name in extra:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
