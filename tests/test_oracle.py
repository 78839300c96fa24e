"""Every fleet query against its DuckDB oracle on sf0.001."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from flotilla.plans.oracle import oracle_sql  # noqa: E402
from flotilla.plans.queries import queries  # noqa: E402
from oracle_check import TABLES, canon  # noqa: E402

from .conftest import SF001  # noqa: E402

QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["mes", "inspecciones", "vehiculos"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    res = duck.execute(SQL[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(d_cols, res.fetchall())
