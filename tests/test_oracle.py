"""Every registered query with an SQL oracle equals DuckDB on the driver tables
(row count, column names and types, exact value multiset after rounding)."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = os.environ.get("TW_TEST_SF", "/root/testdata/sf0.001")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    for f in sdf.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) == dtypes[f.name], f.name
    assert len(srows) == len(drows)
    assert Counter(rows_of(sdf.columns, srows)) == Counter(rows_of(dcols, drows))


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ret_fwd1" in df.columns
