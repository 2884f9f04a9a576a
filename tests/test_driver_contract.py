"""__spark_entry__: smoke query and registered queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from tillpoint.checks import gate

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mom_growth_pct" in df.columns


def test_every_query_has_an_oracle():
    assert set(gate.queries()) == set(gate.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(gate.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = gate.queries()[name](spark, SF)
    res = duck.execute(gate.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [df.columns.index(c) for c in ocols]
    got = sorted((tuple(_norm(r[i]) for i in idx) for r in df.collect()), key=repr)
    want = sorted((tuple(_norm(v) for v in r) for r in res.fetchall()), key=repr)
    assert got == want


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                "MapInPandas", "MapInArrow", "FlatMapCoGroupsInPandas", "AggregateInPandas")


def test_no_python_evaluation_in_any_plan(spark):
    """The retail queries stay JVM-side (no Python UDF / pandas node)."""
    for name, fn in gate.queries().items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in PYTHON_NODES), name
