import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import texts  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return [(i, t, ("en", "fr", None, "Xx!")[k % 4], f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns with the names of results, and of helpers' inputs."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("clash").alias(c) for c in ("name", "n", "score", "shard", "kept", "ids", "line", "a", "b", "words", "hash", "id", "row", "c")))
