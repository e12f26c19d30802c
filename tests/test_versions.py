"""Versioned partition tables and the rollup's refresh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import trips_df
from metrolens import schemas
from metrolens.functions import dates as D
from metrolens.session import scratch_path
from metrolens.sources import versions as V
from metrolens.streaming import rollup as R


def trips(spark):
    return trips_df(spark, [
        ("2024-01-30 08:00", "2024-01-30 09:00", "A", "B", "1", "1"),
        ("2024-01-31 23:50", "2024-02-01 00:10", "A", "B", "1", "1"),
        ("2024-02-01 08:00", "2024-02-01 09:00", "B", "A", "1", "1"),
        ("2024-02-01 08:05", "2024-02-01 09:00", "B", "A", "1", "1"),
        ("2024-02-02 08:00", "2024-02-02 09:00", "B", "C", "1", "2"),
        ("2024-03-05 08:00", None, None, "C", None, "2")])


def rows(df):
    return sorted(map(str, df.select(*schemas.ROLLUP.names).collect()))


def rollup_of(df):
    return R.trip_rollup(df).withColumn("month", F.trunc("day", "month"))


@pytest.mark.parametrize("grain", ["day", "month"])
def test_withdrawn_day_is_emptied_and_others_kept(spark, grain):
    all_trips, path = trips(spark), scratch_path(spark, f"v-{grain}")
    R.write_rollup(R.trip_rollup(all_trips), path, grain)
    assert rows(R.read_rollup(spark, path)) == rows(rollup_of(all_trips))
    gone = F.to_date("time_in") == F.lit(dt.date(2024, 2, 1))
    R.refresh_rollup(all_trips.where(~gone), path, ["2024-02-01"])
    assert rows(R.read_rollup(spark, path)) == rows(rollup_of(all_trips.where(~gone)))
    # 2024-02-01 keeps the exit of the night before; then that trip goes too
    night = F.to_date("time_out") == F.lit(dt.date(2024, 2, 1))
    left = all_trips.where(~gone & ~F.coalesce(night, F.lit(False)))
    R.refresh_rollup(left, path, ["2024-01-31", "2024-02-01"])
    now = R.read_rollup(spark, path)
    assert rows(now) == rows(rollup_of(left)) and now.where("day = DATE'2024-02-01'").count() == 0
    assert R.read_rollup(spark, path, version=1).count() == rollup_of(all_trips).count()
    # everything withdrawn
    R.refresh_rollup(all_trips.limit(0), path, R.event_days(all_trips))
    assert R.read_rollup(spark, path).count() == 0


def test_reader_keeps_its_version_during_a_refresh(spark):
    all_trips, path = trips(spark), scratch_path(spark, "v-reader")
    R.write_rollup(R.trip_rollup(all_trips), path)
    before = R.read_rollup(spark, path)
    want = rows(before)
    R.refresh_rollup(all_trips.limit(0), path, ["2024-02-01", "2024-02-02"])
    assert rows(before) == want and rows(R.read_rollup(spark, path)) != want
    # a write whose manifest entry is still missing is not seen
    spark.createDataFrame([("in", 5, "X", "1", None, None, 1, dt.date(2024, 2, 1), dt.date(2024, 2, 9))],
                          "side string, hour int, station string, line string, peer_station string, peer_line string, n long, month date, day date") \
        .write.partitionBy("day").parquet(f"{path}/data/commit=unfinished")
    assert R.read_rollup(spark, path).where("station = 'X'").count() == 0


def test_partitions_are_pruned_and_listed_by_need(spark):
    path = scratch_path(spark, "v-pruned")
    R.write_rollup(R.trip_rollup(trips(spark)), path)
    R.refresh_rollup(trips(spark), path, ["2024-02-01"])
    plan = R.stations_flow_from_rollup(R.read_rollup(spark, path), "2024-02-01", "2024-02-02")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "2024-02-01" in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert V.read(spark, path, schemas.ROLLUP, lo="2024-02-01", hi="2024-02-01").select("day").distinct().count() == 1


def test_grain_is_kept(spark):
    path = scratch_path(spark, "v-grain")
    R.write_rollup(R.trip_rollup(trips(spark)), path, "month")
    with pytest.raises(ValueError, match="partitioned by month"):
        R.write_rollup(R.trip_rollup(trips(spark)), path, "day")
    with pytest.raises(ValueError, match="grain"):
        R.write_rollup(R.trip_rollup(trips(spark)), path, "hour")


SCHEMA = schemas.T.StructType([schemas.T.StructField("v", schemas.T.LongType()), schemas.T.StructField("k", schemas.T.StringType())])


def table(spark, *kv):
    return spark.createDataFrame([(v, k) for k, v in kv], SCHEMA)


def content(spark, path, **kw):
    return sorted((r["k"], r["v"]) for r in V.read(spark, path, SCHEMA, **kw).collect())


def test_add_replace_reset_and_compaction(spark):
    path = scratch_path(spark, "v-actions")
    assert content(spark, path) == [] and V.current_version(spark, path) == 0 and V.grain_of(spark, path) is None
    V.write(table(spark, ("a", 1), ("b", 2)), path, "k", V.ADD)
    V.write(table(spark, ("a", 3)), path, "k", V.ADD)
    assert content(spark, path) == [("a", 1), ("a", 3), ("b", 2)]
    V.write(table(spark, ("a", 4)), path, "k", V.REPLACE, ["a", "b"])
    assert content(spark, path) == [("a", 4)]
    V.write(table(spark, ("a", 5), ("c", 6)), path, "k", V.ADD)
    assert content(spark, path) == [("a", 4), ("a", 5), ("c", 6)]
    assert V.compact(spark, path, SCHEMA) == ["a"] and content(spark, path) == [("a", 4), ("a", 5), ("c", 6)]
    assert V.folders_per_part(spark, path).agg(F.max("folders")).collect()[0][0] == 1 and V.compact(spark, path, SCHEMA) == []
    V.write(table(spark, ("d", 7)), path, "k", V.RESET)
    assert content(spark, path) == [("d", 7)] and content(spark, path, version=4) == [("a", 4), ("a", 5), ("c", 6)]
    assert content(spark, path, version=2) == [("a", 1), ("a", 3), ("b", 2)]
    free = {r["folder"] for r in V.unused_folders(spark, path, since=6).collect()}
    assert len(free) == 7 and not any("k=d" in f for f in free)
    with pytest.raises(ValueError, match="action"):
        V.write(table(spark, ("d", 7)), path, "k", "merge")
    with pytest.raises(ValueError, match="no partition"):
        V.write(table(spark, (None, 7)), path, "k")


def test_days_as_ranges_reach_the_scan(spark):
    assert D.day_runs(["2024-01-03", "2024-01-01", "2024-01-02", "2024-01-07"]) == [
        (dt.date(2024, 1, 1), dt.date(2024, 1, 3)), (dt.date(2024, 1, 7), dt.date(2024, 1, 7))]
    path = scratch_path(spark, "v-days")
    trips(spark).write.parquet(path)
    df = spark.read.schema(schemas.TRIPS).parquet(path).where(D.on_days(F.to_date("time_in"), ["2024-02-01", "2024-02-02", "2024-03-05"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "time_in" in plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert df.count() == 4 and df.where(D.on_days(F.to_date("time_in"), [])).count() == 0


def test_many_scattered_days_are_one_flat_condition(spark):
    first = dt.date(1990, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(0, 4000, 2)] + [dt.date(2024, 2, 1)]
    runs = D._covering(D.day_runs(days), 3)
    assert len(runs) == 3 and runs[0][0] == first and runs[-1] == (dt.date(2024, 2, 1), dt.date(2024, 2, 1))
    all_days = spark.range(13_000).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    assert sorted(r["day"] for r in all_days.where(D.on_days(F.col("day"), days)).collect()) == days
    assert all_days.where(~D.on_days(F.col("day"), days)).count() == 13_000 - len(days)
    assert all_days.where(D.on_days(F.lit(None).cast("date"), days)).count() == 0
    path = scratch_path(spark, "v-many-days")
    trips(spark).write.parquet(path)
    df = spark.read.schema(schemas.TRIPS).parquet(path).where(D.on_days(F.to_date("time_in"), days))
    assert df.count() == trips(spark).where(F.to_date("time_in") == F.lit(dt.date(2024, 2, 1))).count() > 0
    assert "time_in" in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [", 1)[1].split("]", 1)[0]


def test_refresh_of_many_scattered_days(spark):
    """A withdrawn day whose trips leave on thousands of days."""
    start = dt.datetime(2000, 1, 1, 8)
    out = [(start, start + dt.timedelta(days=i), "A", "B", "1", "1") for i in range(0, 4000, 2)]
    kept = [(start + dt.timedelta(days=1), start + dt.timedelta(days=2), "A", "C", "1", "1")]
    rows_all, rows_left = (spark.createDataFrame(r, schemas.TRIPS) for r in (out + kept, kept))
    path = scratch_path(spark, "v-scattered")
    R.write_rollup(R.trip_rollup(rows_all), path, "month")
    R.refresh_rollup(rows_left, path, R.event_days(spark.createDataFrame(out, schemas.TRIPS)))
    got = sorted((r["side"], r["day"], r["n"]) for r in R.read_rollup(spark, path).collect())
    assert got == [("in", dt.date(2000, 1, 2), 1), ("out", dt.date(2000, 1, 3), 1)]
