import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"w{i % 977} mail{i}@x.example.org" if i % 500 == 0 else f"w{i % 977}" for i in range(20_000))
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44),
    (2, "Alpha beta gamma\tdelta epsilon zeta eta theta", "en", "a", 44),
    (3, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 44),
    (4, "", "en", "a", 0), (5, None, None, "b", None), (6, " \n\t ", "de", "b", 4),
    (7, LONG, "en", "b", len(LONG)), (8, "é ß ñ 😀 word", "fr", "é", 13), (9, "one", "en", "a", 3),
    (10, "one", "en", "c", 3), (10, "one", "en", "c", 3), (None, "no id here at all", "en", "c", 17),
    (None, None, None, None, None), (-5, "two words", "en", "b", 9), (2**40, "call +1 (509) 555-6973 or 1.2.3.4 now", "en", "a", 37),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
