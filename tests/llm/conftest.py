import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHING = ["length", "n", "key", "id", "node", "label", "score", "size", "rank", "band", "seed", "value", "_id", "_range", "_key", "weight", "run", "c", "p", "copy"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    long = " ".join(draw.choice(words) for _ in range(30_000))
    some = " ".join(draw.choice(words) for _ in range(60))
    return [
        (1, some, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (None, some + " and more", "en", "a"),
        (5, long, "en", "c"), (6, some, "en", "b"), (6, some, "en", "b"), (7, "é😀 ﬁ ǅ it's <|endoftext|> \x1c x", "fr", "b"), (8, "one two", "en", None),
        (9, "one two", None, "c"), (10, "password = 'x9Qe7#kLm2Vb' AKIA" + "A" * 20 + " " + "0f" * 20, "en", "a"), (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in odd_rows()], schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, 1, 0), (4, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
