"""Small documents tables with the awkward cases every operator must take."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def docs(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = [(ids[i] if ids else i, texts[i], langs[i] if langs else "en", sources[i] if sources else "s",
             None if texts[i] is None else len(texts[i])) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in as_dicts(df)}
