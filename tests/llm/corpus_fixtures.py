"""Fixtures of the corpus tests, imported by name."""

import os

import pytest
from edge_cases import SCHEMA, edge_rows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def workers(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Documents of the smallest test folder as (doc_id, text), and its items."""
    import duckdb
    d = "/root/testdata/sf0.001"
    return (duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall(),
            duckdb.sql(f"SELECT item_id, text FROM '{d}/benchmark.parquet'").fetchall())
