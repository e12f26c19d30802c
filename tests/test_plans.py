"""Plan checks: what every registered query must (not) contain."""

import pytest

import __spark_entry__ as E
from metrolens.plans import descriptive as Q
from metrolens.plans.inputs import Inputs
from metrolens.sources import testdata as TD

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.transit_queries()) - {"stream_rollup", "stream_windows"}))
def test_no_cross_join_or_row_udf(spark, name):
    plan = _plan(E.transit_queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


@pytest.mark.parametrize("query,cols", [
    (lambda inp: Q.all_stations_flow(inp, "2024-01-05", "2024-01-09"), 4),
    (lambda inp: Q.peak_flow(inp, "2024-01-05", "2024-01-09"), 4),
    (lambda inp: Q.single_month_flow(inp, "2024-01"), 1),
    (lambda inp: Q.line_to_line_flow(inp, "2024-01-05", "2024-01-09"), 3),
])
def test_date_range_pushed_to_scan_and_columns_pruned(spark, query, cols):
    trips = TD.stored_trips(spark, SF, "ev")
    plan = _plan(query(Inputs(trips)))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1                                   # one scan per question
    scan = scans[0]
    pushed = scan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "time_in" in pushed
    schema = scan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert schema.count(":") == cols                          # only the columns used


def test_in_out_counts_single_aggregation(spark):
    trips = TD.stored_trips(spark, SF, "ev")
    plan = _plan(Q.peak_flow(Inputs(trips), "2024-01-01", "2024-01-30"))
    # one partial + one final aggregation around a single shuffle, no sort
    assert plan.count("HashAggregate") == 2
    assert plan.count("Exchange") == 1


def test_entry_day_partitions_are_pruned(spark):
    from metrolens.session import scratch_path
    from metrolens.sources import tables
    path = scratch_path(spark, "pruned")
    tables.write_trips(TD.stored_trips(spark, SF, "ev").select(*E.TRIP_COLUMNS), path)
    trips = tables.read_trips(spark, path, by_day=True)
    for query in (Q.line_to_line_flow(Inputs(trips), "2024-01-05", "2024-01-06"),
                  Q.od_flow(Inputs(trips), "2024-01-05", "2024-01-06")):
        scan = next(line for line in _plan(query).splitlines() if "FileScan parquet" in line)
        filters = scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "entry_day" in filters and "2024-01-05" in filters


def _over_midnight(spark):
    from conftest import trips_df
    return trips_df(spark, [(f"2024-01-{d:02d} 07:30", f"2024-01-{d:02d} 08:30", "A", "B", "1", "1") for d in range(1, 29)]
                    + [("2024-01-04 23:50", "2024-01-05 07:10", "A", "B", "1", "1"),
                       ("2024-01-02 12:00", "2024-01-06 17:00", "A", "C", "1", "2"),      # leaves four days later
                       ("2024-01-20 12:00", "2024-01-05 17:00", "B", "C", "1", "2"),      # leaves before it enters
                       (None, "2024-01-05 08:00", None, "A", None, "1"), ("2024-01-05 08:00", None, "C", None, "2", None)])


def test_exit_days_prune_entry_day_partitions(spark):
    """Q3, Q5, Q6, Q10, Q11 and Q13 on trips stored by entry day with spans."""
    from metrolens.plans import forecast as FC
    from metrolens.session import scratch_path
    from metrolens.sources import tables

    path, raw = scratch_path(spark, "spans"), _over_midnight(spark)
    half = raw.where("station_out = 'B'")
    tables.write_trips(half, path)
    tables.write_trips(raw.exceptAll(half), path, append=True)
    stations = spark.createDataFrame([(1, s, "1", None, i) for i, s in enumerate("ABC")], "id int, station_name string, line_name string, district string, sequence int")
    plain = Inputs(raw, stations=stations)
    inp = Inputs(tables.read_trips(spark, path, by_day=True), stations=stations, trip_spans=tables.read_trip_spans(spark, path))
    panel = lambda spec: lambda i: FC.station_panel(i, "2024-01-07", spec, window=2)
    basis = TD.fixture_basis(FC.model_entities(stations, "station_name", [*FC.STATION_SERIES, *FC.PEAK_SERIES]))
    coef = TD.fixture_ar_coef(spark, [*FC.STATION_SERIES, *FC.PEAK_SERIES])
    queries = {
        "Q3": lambda i: Q.single_station_flow(i, "C", "2024-01-05", "2024-01-06"),
        "Q5": lambda i: Q.peak_flow(i, "2024-01-05", "2024-01-06"),
        "Q6": lambda i: Q.all_stations_flow(i, "2024-01-05", "2024-01-06"),
        "Q10 panel": panel(FC.STATION_SERIES), "Q13 panel": panel(FC.PEAK_SERIES),
        "Q10": lambda i: FC.predict_stations_flow(i, "2024-01-29", basis, coef),
        "Q11": lambda i: FC.predict_single_station_flow(i, "C", "2024-01-29", basis, coef, n=2),
        "Q13": lambda i: FC.predict_peak_flow(i, "2024-01-29", basis, coef),
    }
    for name, query in queries.items():
        assert sorted(map(str, query(inp).collect())) == sorted(map(str, query(plain).collect())), name
    for name in ("Q3", "Q5", "Q6", "Q10 panel", "Q13 panel"):
        scan = next(line for line in _plan(queries[name](inp)).splitlines() if "FileScan parquet" in line)
        filters = scan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
        assert "entry_day" in filters, name
    days = inp.trips_touching("2024-01-05", "2024-01-06").select("entry_day").distinct().collect()
    assert sorted(str(r[0]) for r in days) == ["2024-01-02", "2024-01-04", "2024-01-05", "2024-01-06", "2024-01-20", "None"]
