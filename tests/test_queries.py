"""Every query with SQL against DuckDB on the same tables."""

import os

import pandas as pd
import pytest

from scriptorium.plans import analysis, dataset, language, scoring  # noqa: F401  add their queries
from scriptorium.plans.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "labels", "conversations", "embeddings", "benchmark")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=0)
