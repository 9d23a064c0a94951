"""Every registered query against its DuckDB oracle on the driver tables (sf0.001, and
sf0.01 when QUARRY_SF=0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quarry.session import TABLES
from tools.check_oracle import rows_key

SF = os.environ.get("QUARRY_SF", "0.001")
SF_DIR = f"/root/testdata/sf{SF}"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["dataset"] == "silver/orders"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_DIR)
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLES:
        assert sdf.columns
        return
    rel = con.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert rows_key(sdf.columns, srows) == rows_key(rel.columns, rel.fetchall())
