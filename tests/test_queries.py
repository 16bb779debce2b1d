"""Every registered query on the smallest tables, against its SQL in DuckDB where it has one; and the plans that matter."""

import math
import os
import re

import pytest

import __spark_entry__ as entry_module
from skycatalog.plans import catalog, numbered

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = {**catalog.QUERIES, **numbered.QUERIES}
SQL = {**catalog.ORACLE, **numbered.ORACLE}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = entry_module.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_scans_read_what_is_needed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalog.integration_rollup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(id)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert set(re.findall(r"(\w+):", schema)) == {"id", "updated_at", "frame_type", "target_id", "filter_id", "exposure_seconds"}
    rules_plan = catalog.classify_frames(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in rules_plan
