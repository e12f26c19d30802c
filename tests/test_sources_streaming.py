"""Source readers, test-data views, sinks, rollup and the streaming refresh."""

import datetime as dt

import pytest
from conftest import trips_df
from pyspark.sql import Window
from pyspark.sql import functions as F

from metrolens import schemas
from metrolens.session import scratch_path
from metrolens.sources import sinks, tables, testdata
from metrolens.streaming import rollup as R

SF = "/root/testdata/sf0.001"


def test_read_stations_csv(spark, tmp_path):
    p = tmp_path / "station.csv"
    p.write_text("id,station_name,line_name,district,sequence\n"
                 "1004,Sta1,L1,D1,2\n1006,Sta2,L1,D1,1\n1006,Sta3,L2,D2,1\n")
    st = tables.read_stations(spark, str(p))
    assert st.schema["sequence"].dataType.typeName() == "integer"
    assert st.count() == 3 and st.select("station_name").distinct().count() == 3


def test_trips_ev_equals_plain_lead(spark):
    ev = testdata.events_k(spark, SF)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = (ev.select("event_id", F.lead("event_id").over(w).alias("nxt"))
             .where(F.col("nxt").isNotNull()))
    ranged = testdata.next_event_ranged(ev, "user_id", "ts", "event_id", ["k"], partitions=7) \
        .where(F.col("_nxt").isNotNull()).select("event_id", F.col("_nxt.tie").alias("nxt"))
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0
    assert testdata.trips_ev(spark, SF).count() == plain.count()


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_next_event_ranged_splits_a_hot_key(spark, reuse):
    """One user with most rows: still exact, and spread over many ranges,
    whether or not the planner reuses exchanges."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        _check_hot_key(spark)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def _check_hot_key(spark):
    import datetime as dt3
    t0 = dt3.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 10 else 2 + i % 3, t0 + dt3.timedelta(seconds=i // 2), i % 5) for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, k int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = ev.select("event_id", F.lead("event_id").over(w).alias("nxt")).where(F.col("nxt").isNotNull())
    ranged = testdata.next_event_ranged(ev, "user_id", "ts", "event_id", ["k"], partitions=8) \
        .where(F.col("_nxt").isNotNull()).select("event_id", F.col("_nxt.tie").alias("nxt"))
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0
    spread = ev.repartitionByRange(8, "user_id", "ts", "event_id") \
        .where(F.col("user_id") == 1).select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 6                       # the hot user is cut across ranges


def _order_tables(spark, folder, lines):
    first = F.lit(dt.date(2000, 1, 1))

    def put(name, df):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put("region", spark.createDataFrame([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"))
    put("nation", spark.createDataFrame([(0, "N0", 0), (1, "N1", 1), (1, "N1b", 0), (2, "N2", None)], "n_nationkey int, n_name string, n_regionkey int"))
    put("customer", spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (4, 2)], "c_custkey long, c_nationkey int"))
    put("supplier", spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 7)], "s_suppkey long, s_nationkey int"))
    put("orders", spark.range(lines // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 6).alias("o_custkey"),
                                                 F.date_add(first, (F.col("id") % 900).cast("int")).cast("timestamp").alias("o_orderdate")))
    put("lineitem", spark.range(lines).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 5).alias("l_suppkey"),
                                              F.date_add(first, (F.col("id") % 977).cast("int")).cast("timestamp").alias("l_shipdate")))


def test_trips_od_rows_and_partitions_bounded_by_size(spark, tmp_path):
    """Keys that repeat or lead nowhere count as in plain joins; rows are dealt
    anew before they are sorted, so a task does not hold what one task joined."""
    _order_tables(spark, str(tmp_path), 40_000)
    t = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    nr = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    place = lambda s: nr.select(F.col("n_nationkey").alias(f"{s}_nationkey"), F.col("n_name").alias(f"station_{s}"), F.col("r_name").alias(f"line_{s}"))
    plain = (t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(place("c"), "c_nationkey")
             .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(place("s"), "s_nationkey")
             .select("o_custkey", "o_orderdate", "l_shipdate", "station_c", "line_c", "station_s", "line_s"))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = testdata.trips_od(spark, str(tmp_path))
        assert got.columns == ["user_id", "time_in", "time_out", "station_in", "line_in", "station_out", "line_out"]
        got.write.parquet(f"{tmp_path}/got")                # a file per task
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = spark.read.parquet(f"{tmp_path}/got")
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert got.count() == plain.count() == sum(sizes) > 0
    assert got.exceptAll(plain).count() == 0
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 8


def test_calendar_view(spark):
    cal = {r["time"]: r["workday"] for r in testdata.workdays_v(spark, SF).collect()}
    assert dt.date(2024, 1, 15) not in cal
    assert cal[dt.date(2024, 1, 1)] == 0 and cal[dt.date(2024, 1, 6)] == 0 and cal[dt.date(2024, 1, 2)] == 1


def test_to_nested(spark):
    df = spark.createDataFrame([("A", "2024-01-02", 3), ("A", "2024-01-01", 1), ("B", "2024-01-01", 2)],
                               "station string, time string, flow long")
    out = {r["station"]: [tuple(x) for x in r["items"]] for r in sinks.to_nested(df, ["station"]).collect()}
    assert out == {"A": [("2024-01-01", 1), ("2024-01-02", 3)], "B": [("2024-01-01", 2)]}


def _trips(spark):
    rows = []
    for d in range(1, 6):
        for h in (7, 8, 17, 22):
            t_in = f"2024-01-0{d}T{h:02d}:15:00"
            t_out = f"2024-01-0{d}T{h:02d}:45:00"
            rows.append((t_in, t_out, "A", "B", "L1", "L2"))
    return trips_df(spark, rows)


def test_rollup_answers_match_trips(spark):
    from metrolens.plans import descriptive as Q
    from metrolens.plans.inputs import Inputs
    trips = _trips(spark)
    path = scratch_path(spark, "test-rollup")
    R.write_rollup(R.trip_rollup(trips), path)
    # refresh of one day replaces only that day's partition
    R.write_rollup(R.trip_rollup(trips.where(F.to_date("time_in") == F.lit(dt.date(2024, 1, 3)))), path)
    rollup = R.read_rollup(spark, path)
    a = sorted(R.stations_flow_from_rollup(rollup, "2024-01-01", "2024-01-05").collect())
    b = sorted(Q.all_stations_flow(Inputs(trips), "2024-01-01", "2024-01-05").collect())
    assert a == b
    a = sorted(R.peak_flow_from_rollup(rollup, "2024-01-02", "2024-01-04").collect())
    b = sorted(Q.peak_flow(Inputs(trips), "2024-01-02", "2024-01-04").collect())
    assert a == b


def _overnight(spark):
    """Trips that end on a later day than they begin, and a null exit."""
    rows = [(f"2024-01-0{d}T23:{m:02d}:00", f"2024-01-0{d + 1}T00:{m:02d}:00", "A" if m % 2 else "B", "C", "L1", "L2")
            for d in range(1, 6) for m in range(0, 50, 5)]
    return trips_df(spark, rows + [("2024-01-03T08:00:00", None, "A", None, "L1", None)])


def _rows(df):
    return sorted(map(str, df.select(*R.ROLLUP_KEYS, "n").collect()))


def test_refresh_of_a_day_keeps_the_other_days(spark):
    trips = _overnight(spark)
    path = scratch_path(spark, "test-refresh")
    R.write_rollup(R.trip_rollup(trips), path)
    R.refresh_rollup(trips, path, ["2024-01-03"])
    assert _rows(R.read_rollup(spark, path)) == _rows(R.trip_rollup(trips))
    # trips that arrive late change every day they count on, and no other
    late = F.to_date("time_in") == F.lit(dt.date(2024, 1, 2))
    path = scratch_path(spark, "test-refresh-late")
    R.write_rollup(R.trip_rollup(trips.where(~late)), path)
    days = R.event_days(trips.where(late))
    assert days == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    R.refresh_rollup(trips, path, days)
    assert _rows(R.read_rollup(spark, path)) == _rows(R.trip_rollup(trips))


def test_stream_rollup_equals_batch_in_any_order(spark):
    trips = _overnight(spark)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    for d in (4, 1, 5, 2, 3):                       # one micro-batch per file, days out of order
        trips.where(F.dayofmonth("time_in") == d).coalesce(1).write.mode("append").parquet(src)
    R.stream_rollup(spark, src, sink, ckpt, max_files_per_trigger=1).awaitTermination()
    assert _rows(R.read_stream_rollup(spark, sink)) == _rows(R.trip_rollup(trips))


def test_stream_counts_repeated_trips(spark):
    trips = _overnight(spark)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src3", "sink3", "ckpt3"))
    trips.union(trips).write.parquet(src)
    R.stream_rollup(spark, src, sink, ckpt).awaitTermination()
    assert _rows(R.read_stream_rollup(spark, sink)) == _rows(R.trip_rollup(trips.union(trips)))


def test_json_records_round_trip(spark):
    df = spark.createDataFrame([("A", 1, None), ("B", 2, 3)], "station string, flow_in long, flow_out long")
    back = sinks.from_json_records(sinks.to_json_records(df), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_read_trips_with_original_names(spark, tmp_path):
    import datetime as dt2
    df = spark.createDataFrame(
        [(dt2.datetime(2024, 1, 1, 8), dt2.datetime(2024, 1, 1, 9), "A", "B", "L1", "L2")],
        "t_in timestamp_ntz, t_out timestamp_ntz, s_in string, s_out string, l_in string, l_out string")
    path = str(tmp_path / "trips")
    df.write.parquet(path)
    rename = {"time_in": "t_in", "time_out": "t_out", "station_in": "s_in", "station_out": "s_out",
              "line_in": "l_in", "line_out": "l_out"}
    t = tables.read_trips(spark, path, rename)
    assert t.columns == ["time_in", "time_out", "station_in", "station_out", "line_in", "line_out"]
    assert t.collect()[0]["station_out"] == "B"


def test_stream_rollup_restarts_from_checkpoint(spark):
    """Stop after the first files, add more, restart on the same checkpoint:
    nothing is lost or counted twice."""
    trips = _overnight(spark)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src2", "sink2", "ckpt2"))
    for d in (1, 2):
        trips.where(F.dayofmonth("time_in") == d).coalesce(1).write.mode("append").parquet(src)
    R.stream_rollup(spark, src, sink, ckpt).awaitTermination()
    assert _rows(R.read_stream_rollup(spark, sink)) == _rows(R.trip_rollup(trips.where(F.dayofmonth("time_in") < 3)))
    for d in (3, 4, 5):
        trips.where(F.dayofmonth("time_in") == d).coalesce(1).write.mode("append").parquet(src)
    R.stream_rollup(spark, src, sink, ckpt).awaitTermination()
    assert _rows(R.read_stream_rollup(spark, sink)) == _rows(R.trip_rollup(trips))


def _one_file_each(spark, trips, src, order):
    for d in order:
        trips.where(F.dayofmonth("time_in") == d).coalesce(1).write.mode("append").parquet(src)


@pytest.mark.parametrize("order", [(1, 2, 3, 4, 5), (5, 1, 2, 4, 3), (2, 1, 4, 5, 3)])
def test_windows_and_late_side_add_up(spark, order):
    """Closed hours + late rows + open hours = the batch rollup in any file
    order; a closed hour is complete but for what the late side holds."""
    trips = _overnight(spark)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("wsrc", "wsink", "wckpt"))
    seen = {}
    for i, d in enumerate(order):                       # one restart per file
        _one_file_each(spark, trips, src, [d])
        R.stream_windows(spark, src, sink, ckpt, delay_hours=6).awaitTermination()
        closed = {str(r) for r in R.read_windows(spark, sink).collect()}
        assert set(seen) <= closed                      # what was closed never changes
        seen = dict.fromkeys(closed)
    late = R.read_windows(spark, sink, (R.LATE,))
    assert (late.count() == 0) == (order == (1, 2, 3, 4, 5))
    now = R._watermark(spark, sink)
    ends = F.unix_timestamp(F.col("day").cast("timestamp")) + (F.col("hour") + 1) * 3600
    assert R.read_windows(spark, sink).where(ends > now).count() == 0
    assert R.read_windows(spark, sink, (R.OPEN,)).where(ends <= now).count() == 0
    everything = R.read_windows(spark, sink, (R.CLOSED, R.LATE, R.OPEN)).groupBy(*R.ROLLUP_KEYS).agg(F.sum("n").alias("n"))
    assert _rows(everything) == _rows(R.trip_rollup(trips))
    R.close_windows(spark, sink)
    assert R.read_windows(spark, sink, (R.OPEN,)).count() == 0
    final = R.read_windows(spark, sink, (R.CLOSED, R.LATE)).groupBy(*R.ROLLUP_KEYS).agg(F.sum("n").alias("n"))
    assert _rows(final) == _rows(R.trip_rollup(trips))


@pytest.mark.parametrize("stream,read", [
    (R.stream_rollup, lambda s, p: R.read_stream_rollup(s, p)),
    (lambda *a, **k: R.stream_windows(*a, delay_hours=6, **k),
     lambda s, p: R.read_windows(s, p, (R.CLOSED, R.LATE, R.OPEN)).groupBy(*R.ROLLUP_KEYS).agg(F.sum("n").alias("n")))])
def test_repeated_batch_is_not_counted_twice_and_files_stay_bounded(spark, stream, read):
    """A batch whose commit was lost is run again on restart."""
    import pathlib

    from metrolens.sources import versions
    trips = _overnight(spark).where(F.dayofmonth("time_in") <= 2)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("rsrc", "rsink", "rckpt"))
    for k in range(3):
        _one_file_each(spark, trips.where(F.minute("time_in") % 3 == k), src, (1, 2))
    stream(spark, src, sink, ckpt, max_files_per_trigger=1, most_folders=2).awaitTermination()
    assert versions.folders_per_part(spark, sink).agg(F.max("folders")).collect()[0][0] <= 2
    assert _rows(read(spark, sink)) == _rows(R.trip_rollup(trips))
    commits = sorted(pathlib.Path(ckpt, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    stream(spark, src, sink, ckpt, max_files_per_trigger=1, most_folders=2).awaitTermination()
    assert _rows(read(spark, sink)) == _rows(R.trip_rollup(trips))


def test_parameter_tables_round_trip(spark, tmp_path):
    """A numpy basis imports in sorted-name row order; parameter
    tables and fitted pipelines survive write/read."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from metrolens.sources import models
    p = np.array([[1.0, 0.0], [0.5, 2.0], [0.0, 3.0]])
    np.save(tmp_path / "P.npy", p)
    basis = models.basis_from_npy(spark, str(tmp_path / "P.npy"), "station_in", ["S2", "S0", "S1"])
    got = {(r["entity"], r["factor"]): r["weight"] for r in basis.collect()}
    assert got == {("S0", 0): 1.0, ("S0", 1): 0.0, ("S1", 0): 0.5, ("S1", 1): 2.0, ("S2", 0): 0.0, ("S2", 1): 3.0}   # zeros kept
    models.write_params(basis, str(tmp_path / "basis"))
    assert sorted(models.read_basis(spark, str(tmp_path / "basis")).collect()) == sorted(basis.collect())
    train = spark.createDataFrame([(float(x), 2.0 * x + 1.0) for x in range(10)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LinearRegression()]).fit(train)
    models.save_model(model, str(tmp_path / "model"))
    again = models.load_model(str(tmp_path / "model"))
    a = [r["prediction"] for r in model.transform(train).collect()]
    b = [r["prediction"] for r in again.transform(train).collect()]
    assert a == b


def test_stream_files_need_only_the_trips_and_can_be_shared_by_tasks(spark, tmp_path, monkeypatch):
    """No other view is derived for the streams; a file of a micro-batch has
    several row groups, as one group is read by one task."""
    import pathlib

    import __spark_entry__ as E
    import pyarrow.parquet as pq
    at = F.timestamp_seconds(1_704_067_200 + F.col("id") * 37).cast(schemas.EVENTS["ts"].dataType)
    spark.range(20_000).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("x").alias("event_type"),
                               F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id") * 31 % 97).alias("props")) \
        .write.parquet(f"{tmp_path}/events.parquet")
    views = []
    stored = testdata.stored_view
    monkeypatch.setattr(testdata, "stored_view", lambda s, d, name: views.append(name) or stored(s, d, name))
    monkeypatch.setattr(E, "STREAM_ROW_GROUP", 8192)
    src = scratch_path(spark, "stream-files")
    E._write_stream_files(spark, str(tmp_path), src)
    files = [pq.ParquetFile(p) for p in pathlib.Path(src).glob("*.parquet")]
    assert len(files) == E.STREAM_FILES and min(f.num_row_groups for f in files) > 1
    assert sum(f.metadata.num_rows for f in files) == 20_000 - 50
    windows = E.stream_windows(spark, str(tmp_path))
    assert set(views) == {"trips_ev"}
    assert windows.exceptAll(R.trip_rollup(stored(spark, str(tmp_path), "trips_ev")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
                             .select(*windows.columns)).count() == 0
