"""Every query with an oracle against DuckDB on the smallest tables; the others run and have a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in entry.oracle_sql():
        r = sql.execute(entry.oracle_sql()[name])
        named = [x[0] for x in r.description]
        assert sorted(named) == columns
        assert rows == sorted(repr(tuple(_norm(x[named.index(c)]) for c in columns)) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file", "line_no", "last_line_no", "ts_ms", "level", "source"]
