"""Every registered query of the engine's own operators against DuckDB, over whole tables."""

import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, name, tmp_path):
    catalog.QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(oracle.sql(catalog.ORACLE_SQL[name]).columns))
    got = oracle.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'").fetchall()
    want = oracle.sql(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["ancestor_closure_whole", "descendant_rollup_whole"])
def test_every_customer_is_a_root(spark, oracle, name):
    roots = {r.root for r in catalog.QUERIES[name](spark, DATA).select("root").distinct().collect()}
    assert roots == {str(k) for (k,) in oracle.sql("SELECT c_custkey FROM customer").fetchall()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_rows_follow_no_id(spark, oracle):
    got = {r.k for r in catalog.QUERIES["recycle_retry_whole"](spark, DATA).collect()}
    assert any(k % 2 for k in got) and any(k % 2 == 0 for k in got)
    assert got == {k for (k,) in oracle.sql(f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_custkey::VARCHAR NOT IN ({catalog._REF})").fetchall()}
