import string

import pytest

TABLE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

ODD = [
    (9001, None),
    (9002, ""),
    (9003, " \n\n  a  b'll don't \t\x1f x　y 12,34!! \U0001f600 <|endoftext|>  z é ÀÉß± µ ª İI abc<|endoftext|> <|startoftext|>hello, x'S don'T (it's) ²³ Ⅷ\x85q\xa0r​s﻿"),
    (9004, "x" * 5000),
    (9005, "One two three."),
    (9005, "One two three."),
    (9006, "a b c d e f g h i"),
    (9007, "A b c d e f g h i j"),
    (None, "no id here"),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The smallest documents, odd rows, and columns with names that operators use themselves."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, d.schema)
    from pyspark.sql import functions as F

    return d.unionByName(odd).coalesce(2).select("doc_id", "text", F.lit(1).alias("n"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("node"), F.lit(0).alias("row"))


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n int")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(got, expected):
        assert ordered(got) == ordered(expected)

    return check


@pytest.fixture(scope="session")
def lower():
    return lambda t: (t or "").translate(TABLE)
