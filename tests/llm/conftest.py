import os
import sys

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of some texts, with ids from 0."""

    def make(texts, lang="en", source="s", n_partitions=3):
        rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(n_partitions)

    return make


@pytest.fixture(scope="session")
def some_docs(spark, testdata):
    return spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
