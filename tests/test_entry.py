"""Registered queries against their SQL, on the small tables where those are present."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_scans_read_only_what_is_used(spark):
    from tessera.sources.files import explain_text

    plan = explain_text(__spark_entry__.queries()["follower_count_reduce"](spark, DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan and "ReadSchema: struct<p_partkey:bigint>" in plan


def test_null_filters_reach_the_scan(spark):
    from tessera.sources.files import explain_text

    assert "PushedFilters: [IsNotNull(o_custkey)" in explain_text(__spark_entry__.queries()["edges_max_filter"](spark, DIR))
