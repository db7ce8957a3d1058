import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("words", T.LongType()), T.StructField("score", T.StringType()),
])
LONG = "word " * 60_000
EDGE_TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "A line that is long enough\nshort"), (5, "a line that is long enough \n\nmore of it"),
    (5, "a line that is long enough \n\nmore of it"), (None, "a line that is long enough"), (None, None), (6, LONG), (7, LONG + "end"),
    (8, "mail a.b@c.de and a@b, call +1 (555) 123-4567 now"), (9, "Übergroße Ñandúes 日本語 😀 ÀÉ"), (10, "\x00\x1f  \x0b"), (11, "x" * 50_000),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "fp", 1, None) for i, t in EDGE_TEXTS], DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
