"""Every registered query against its DuckDB oracle on the smallest test data
(the driver repeats this at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import oracles
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
QUERIES = E.transit_queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_a_fit():
    no_oracle = set(QUERIES) - set(ORACLES)
    assert no_oracle <= {"fit_basis", "forecast_stations_fitted", "forecast_total_gbt", "forecast_panel_gbt"}
    assert set(ORACLES) <= set(QUERIES)


def test_order_history_is_read_whole(spark):
    trips = E.od_inputs(spark, SF).trips.count()
    flow = lambda name, col: QUERIES[name](spark, SF).groupBy().sum(col).first()[0]
    assert flow("line_flow", "flow") == flow("stations_flow_od", "flow_in") == flow("line_flow_from_rollup", "flow") == trips


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["station", "flow_in", "flow_out"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLES:
        assert len(srows) > 0
        return
    cur = con.execute(ORACLES[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    hs, cs, _ = digest(sdf.columns, srows)
    ho, co, _ = digest(ocols, orows)
    assert cs == co
    assert len(srows) == len(orows)
    assert hs == ho
