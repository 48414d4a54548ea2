"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from binsight.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v.isoformat() if hasattr(v, "isoformat") else v
    out = [tuple(n(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 24
    assert df.columns[:2] == ["hour", "total_count"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    sql = E.oracle_sql().get(key)
    assert sql is not None, f"{key} has no oracle"
    rel = con.sql(sql)
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(rel.fetchall(), rel.columns)
