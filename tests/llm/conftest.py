"""Fixtures of the numbered operators' tests."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, clashing extra columns."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, "word " * 40_000), (6, "a\x1cb  c \n d<|endoftext|>é…")]
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, label_id string, size int, print int, shard int")
