"""Fixtures' tables and plain-Python versions shared by the tests of the corpus operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: The same with further columns, some named like columns of results.
WIDE = T.StructType([*DOCS.fields, T.StructField("lang", T.StringType()), T.StructField("keep_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.StringType()), T.StructField("length", T.StringType()), T.StructField("start", T.StringType())])


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (len(schema) - 2) for r in rows], schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


SF = "/root/testdata/sf0.01"
