import os

import pytest
from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows, and columns whose names clash with internal ones."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "same words here again and again " * 3),
            (6, "same words here again and again " * 3), (7, "x" * 70_000), (8, "long text word " * 9_000),
            (None, "no id at all but some words"), (9, "ünïcödé 日本 \U0001f600 text\x00nul ▁ <s> <|endoftext|>"),
            (10, "the the the the"), (11, "123 456 !!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit("z").alias(c) for c in (
        "id", "kept", "n", "_part", "_rank", "length", "chunk", "row", "rep", "comp", "bucket", "run", "_spans", "lang")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long, extra int")


@pytest.fixture(scope="session")
def vocab():
    from flowlens.llm.queries import vocabulary
    return vocabulary


def table(spark, path):
    return spark.read.parquet(os.path.join(SF001, path))
