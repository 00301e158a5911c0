"""Every named query against its SQL on the smallest tables, and contracts of the entry point."""

import glob

import duckdb
import pandas as pd
import pytest

from sievework import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> list:
    def one(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        return "null" if v is None or pd.isna(v) else "%.9g" % v if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_cartesian_products_but_unit_grids(spark):
    allowed = {"cond_rates_grid", "resume_pending_units", "worst_rank_for_missing", "interleaved_order", "litmus_comparison"}
    for name in set(ORACLES) - allowed:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name
