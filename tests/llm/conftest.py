import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

#: Nulls in each column, empty and white-space texts, a long text, ties, repeated rows, odd characters.
ODD = [
    (1, "the same words stand here and there and here again", "en", "a", 5),
    (2, "the same words stand here and there and here again", "en", "b", 5),
    (2, "the same words stand here and there and here again", "en", "b", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n", "en", "a", 3),
    (6, "word " * 30_000, "en", "a", 150_000),
    (7, "é😀 ß x　y", "fr", "a", 3),
    (8, "one", "en", None, 3),
    (None, "a row without an id", "en", "a", 1),
    (9, "THE SAME words stand here and there and here again", "en", "b", 5),
    (-4, "a negative id <|endoftext|> and a mark", "en", "c", 5),
    (10, "nul \x00 byte and é á combined", "en", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns have names that operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCUMENTS)
    return df.withColumns({"digest": F.lit("x"), "row": F.lit(1), "n": F.lit(2), "bucket": F.lit(3), "words": F.lit(9), "members": F.lit("m"), "node": F.lit(0), "key": F.lit("k")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
