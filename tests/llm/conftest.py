import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import SCHEMA, SF, rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, copies, repeated rows and ids, and
    further columns named like those the operators use inside."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c
