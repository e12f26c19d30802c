"""Edge cases of the descriptive queries (FIXTURES.md section 3)."""

import datetime as dt

from conftest import trips_df

from metrolens import schemas
from metrolens.plans import descriptive as Q
from metrolens.plans.inputs import Inputs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hour_bands_inclusive_on_hour(spark):
    day = "2024-01-02"
    times = ["06:59:59", "07:00:00", "08:59:59", "09:00:00",
             "15:59:59", "16:00:00", "18:59:59", "19:00:00"]
    trips = trips_df(spark, [(f"{day}T{t}", f"{day}T{t}", "A", "A", "L1", "L1") for t in times])
    out = rows(Q.peak_flow(Inputs(trips), day, day))
    # morning: 07:00:00 and 08:59:59; evening: 16:00:00 and 18:59:59 - entries and exits alike
    assert out == [("evening", "A", 2, 2), ("morning", "A", 2, 2)]


def test_date_range_bounds(spark):
    trips = trips_df(spark, [
        ("2024-01-01T00:00:00", "2024-01-01T00:10:00", "A", "B", "L1", "L1"),
        ("2024-01-03T23:59:59.999999", "2024-01-04T00:00:00", "A", "B", "L1", "L1"),
        ("2024-01-04T00:00:00", "2024-01-04T00:05:00", "A", "B", "L1", "L1"),
        ("2023-12-31T23:59:59.999999", "2024-01-01T00:00:01", "A", "B", "L1", "L1"),
    ])
    out = rows(Q.all_stations_flow(Inputs(trips), "2024-01-01", "2024-01-03"))
    # entries counted on the entry day (2 inside); B has exits only and is left out
    assert out == [("A", 2, None)]
    flows = dict(((r["station"], (r["flow_in"], r["flow_out"])) for r in
                  Q.all_stations_flow(Inputs(trips), "2024-01-01", "2024-01-04").collect()))
    assert flows == {"A": (3, None)}


def test_in_out_merge_semantics(spark):
    d = "2024-01-05T10:00:00"
    trips = trips_df(spark, [
        (d, d, "IN_ONLY", "BOTH", "L1", "L1"),
        (d, d, "BOTH", "OUT_ONLY", "L1", "L1"),
        (d, d, None, None, "L1", "L1"),
        (d, d, None, "BOTH", "L1", "L1"),
    ])
    q6 = rows(Q.all_stations_flow(Inputs(trips), "2024-01-05", "2024-01-05"))
    by = {r[0]: r[1:] for r in q6}
    assert by["IN_ONLY"] == (1, None)          # missing exit count stays null
    assert by["BOTH"] == (1, 2)
    assert "OUT_ONLY" not in by                # anchored on entries
    assert by[None] == (2, 1)                  # null stations form a group and match
    q5 = Q.peak_flow(Inputs(trips), "2024-01-05", "2024-01-05").collect()
    assert q5 == []                            # 10:00 is in no peak
    filled = {r["station"]: r["flow_out"] for r in
              Q.all_stations_flow(Inputs(trips), "2024-01-05", "2024-01-05", fill=0).collect()}
    assert filled["IN_ONLY"] == 0


def _calendar(spark, days):
    return spark.createDataFrame([(dt.date.fromisoformat(d), w) for d, w in days], schemas.WORKDAYS)


def test_day_type_flow(spark):
    trips = trips_df(spark, [
        ("2024-01-06T08:00:00", "2024-01-06T09:00:00", "A", "B", "L", "L"),   # Sat
        ("2024-01-08T08:00:00", "2024-01-08T09:00:00", "A", "B", "L", "L"),   # Mon
        ("2024-01-08T09:00:00", "2024-01-08T09:30:00", "A", "B", "L", "L"),
        ("2024-01-09T08:00:00", "2024-01-09T09:00:00", "A", "B", "L", "L"),   # not in calendar
    ])
    cal = _calendar(spark, [("2024-01-06", 0), ("2024-01-07", 0), ("2024-01-08", 1)])
    inp = Inputs(trips, workdays=cal)
    assert rows(Q.day_type_flow(inp, "2024-01-01", "2024-01-31")) == [(2.0, 1.0)]
    # weekends only: the workday group is empty -> 0
    assert rows(Q.day_type_flow(inp, "2024-01-06", "2024-01-07")) == [(0.0, 1.0)]
    # empty range: both 0
    assert rows(Q.day_type_flow(inp, "2025-01-01", "2025-01-02")) == [(0.0, 0.0)]


def test_age_bins(spark):
    users = spark.createDataFrame(
        [(0, 2021), (0, 2020), (0, 2011), (0, 2010), (0, 1921), (0, 1920), (0, None), (0, 2022)],
        schemas.USERS)   # ages 0, 1, 10, 11, 100, 101, null, -1; only males
    out = Q.age_structure(Inputs(trips=None, users=users)).collect()
    assert len(out) == 20
    male = {r["bin"]: r["n"] for r in out if r["sex"] == "male"}
    female = {r["bin"]: r["n"] for r in out if r["sex"] == "female"}
    assert male[1] == 2 and male[2] == 1 and male[10] == 1
    assert sum(male.values()) == 4            # 0, 101, null and -1 fall out
    assert set(female.values()) == {0}


def test_line_to_line_and_identities(spark):
    trips = trips_df(spark, [
        ("2024-01-02T08:00:00", "2024-01-02T09:00:00", "A", "B", "L1", "L2"),
        ("2024-01-02T08:00:00", "2024-01-02T09:00:00", "A", "A2", "L1", "L1"),
        ("2024-01-03T08:00:00", "2024-01-03T09:00:00", "B", "A", "L2", "L1"),
    ])
    inp = Inputs(trips)
    l2l = rows(Q.line_to_line_flow(inp, "2024-01-01", "2024-01-31"))
    assert l2l == [("L1", "L1", 1), ("L1", "L2", 1), ("L2", "L1", 1)]
    total_in = sum(r["flow_in"] for r in Q.all_stations_flow(inp, "2024-01-01", "2024-01-31").collect())
    assert total_in == sum(r[2] for r in l2l) == 3
    od = Q.od_flow(inp, "2024-01-01", "2024-01-31").collect()
    assert sum(r["flow"] for r in od) == 3


def test_single_station_and_month(spark):
    trips = trips_df(spark, [
        ("2024-01-31T23:00:00", "2024-02-01T00:30:00", "A", "B", "L", "L"),
        ("2024-02-01T08:00:00", "2024-02-01T09:00:00", "B", "A", "L", "L"),
    ])
    inp = Inputs(trips)
    assert rows(Q.single_month_flow(inp, "2024-01")) == [("2024-01-31", 1)]
    assert rows(Q.single_month_flow(inp, "2024-02")) == [("2024-02-01", 1)]
    st = rows(Q.single_station_flow(inp, "A", "2024-01-31", "2024-02-01"))
    assert st == [("A", "in", "2024-01-31", 1), ("A", "out", "2024-02-01", 1)]


def test_reference_record_shapes(spark):
    from metrolens.plans import records
    trips = trips_df(spark, [
        ("2024-01-02T07:30:00", "2024-01-02T08:10:00", "A", "B", "L", "L"),
        ("2024-01-02T17:30:00", "2024-01-02T17:50:00", "B", "A", "L", "L"),
        ("2024-01-03T07:30:00", "2024-01-03T08:10:00", "A", "B", "L", "L"),
    ])
    inp = Inputs(trips)
    peak = records.peak_lists(Q.peak_flow(inp, "2024-01-01", "2024-01-31")).collect()[0]
    # anchored on entries: B's morning exits and A's evening exits are dropped
    assert [tuple(x) for x in peak["morning"]] == [("A", 2, 0)]
    assert [tuple(x) for x in peak["evening"]] == [("B", 1, 0)]
    st = records.station_series(Q.single_station_flow(inp, "A", "2024-01-01", "2024-01-31")).collect()[0]
    assert st["station"] == "A"
    assert [tuple(x) for x in st["flow_in"]] == [("2024-01-02", 1), ("2024-01-03", 1)]
    assert [tuple(x) for x in st["flow_out"]] == [("2024-01-02", 1)]
    users = spark.createDataFrame([(0, 1990), (1, 1985), (1, 1950)], schemas.USERS)
    ages = records.age_lists(Q.age_structure(Inputs(trips=None, users=users))).collect()[0]
    assert ages["male"] == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert ages["female"] == [0, 0, 0, 1, 0, 0, 0, 1, 0, 0]
