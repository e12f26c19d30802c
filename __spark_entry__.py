"""

``entry(spark)`` runs the flagship query (all-stations flow) on
/root/testdata/sf0.001; ``queries()`` lists one callable per implemented
over the test views of FIXTURES.md; ``oracle_sql()`` gives the DuckDB SQL
answering the same question from the raw tables.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable

# The driver may load this file by path: make the package next to it importable.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles as O
from metrolens.operators import counts, lowrank, sections, series
from metrolens.functions import dates as D
from metrolens.functions.dates import date_str, trailing_window
from metrolens.plans import descriptive as Q
from metrolens.plans import fit as FIT
from metrolens.plans import forecast as FC
from metrolens.plans import records
from metrolens.session import scratch_path
from metrolens.streaming import rollup as R
from metrolens.plans.inputs import Inputs
from metrolens.sources import models, sinks, tables
from metrolens.sources import testdata as TD

# The training-data operators are an optional part: without their folder the
# other queries still work. An import error inside them is not hidden.
try:
    import corpus_pipeline
    from metrolens.llm import queries as LLM
    from metrolens.llm import sql as LLM_SQL
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "metrolens.llm"):
        raise
    LLM = None

FLAGSHIP_SF = "/root/testdata/sf0.001"


def ev_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(trips=TD.stored_trips(spark, sf_dir, "ev"), users=TD.users_v(spark, sf_dir),
                  workdays=TD.stored_view(spark, sf_dir, "workdays_v"),
                  stations=TD.stored_view(spark, sf_dir, "stations_ev"))


def od_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(trips=TD.stored_trips(spark, sf_dir, "od"), users=TD.users_v(spark, sf_dir),
                  workdays=TD.stored_view(spark, sf_dir, "workdays_od"),
                  stations=TD.stored_view(spark, sf_dir, "stations_od"))


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    """Round double columns so engines agree on the last bits of means."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def _station_params(spark: SparkSession, inp: Inputs, models):
    ents = FC.model_entities(inp.stations, "station_name", models)
    return TD.fixture_basis(ents), TD.fixture_ar_coef(spark, list(models))


def _section_params(spark: SparkSession, inp: Inputs):
    ents = FC.model_entities(FC.section_list(inp), "entity", FC.SECTION_MODELS)
    return TD.fixture_basis(ents), TD.fixture_ar_coef(spark, list(FC.SECTION_MODELS))


def station_day_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    lo, hi = trailing_window(O.EV_FORECAST_START, O.WINDOW)
    panel = counts.station_day_counts(inp.trips, lo, hi, FC.STATION_SERIES)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    dense = series.densify_range(panel, ents, ["model", "entity"], lo, hi)
    return dense.select("model", "entity", date_str("day").alias("day"), F.col("flow").cast("long").alias("flow"))


def station_day_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    lo, hi = trailing_window(O.EV_FORECAST_START, O.WINDOW)
    panel = counts.station_day_counts(inp.trips, lo, hi, {"station_in": ("in", None)})
    wide = series.pivot_days(panel.withColumnRenamed("entity", "station"), "station", lo, hi)
    return wide.select("station", *[F.col(c).cast("long").alias(c) for c in wide.columns if c != "station"])


def od_daily_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    od = counts.od_counts(inp.trips, O.EV_START, O.EV_END, by_day=True)
    dense = series.densify_span(od, ["station_in", "station_out"])
    return dense.select("station_in", "station_out", date_str("day").alias("day"), "flow")


def lag_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = od_inputs(spark, sf_dir)
    daily = counts.station_day_counts(inp.trips, O.OD_START, O.OD_END, {"station_in": ("in", None)})
    dense = series.densify_span(daily.select(F.col("entity").alias("station"), "day", "flow"), ["station"])
    feats = series.lag_features(dense, ["station"])
    return feats.withColumn("day", date_str("day"))


def forecast_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.predict_total_flow(ev_inputs(spark, sf_dir), O.EV_FORECAST_START, O.FORECAST_STEPS,
                                 TD.FIXTURE_TOTAL)


def forecast_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive linear forecast of every station's entries (E6 over a panel)."""
    inp = ev_inputs(spark, sf_dir)
    lo, hi = trailing_window(O.EV_FORECAST_START, series.TREND_LAG)
    daily = counts.station_day_counts(inp.trips, lo, hi, {"station_in": ("in", None)}) \
        .select(F.col("entity").alias("station"), "day", "flow")
    stations = inp.stations.select(F.col("station_name").alias("station"))
    fc = series.recursive_forecast(daily, inp.workdays, ["station"], TD.FIXTURE_TOTAL,
                                   O.EV_FORECAST_START, O.FORECAST_STEPS, entities=stations)
    return fc.select("station", date_str("day").alias("time"), "is_workday", "flow")


def basis_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, _ = _station_params(spark, inp, FC.STATION_SERIES)
    q = lowrank.project(FC.station_panel(inp, O.EV_FORECAST_START), lowrank.projection_weights(basis))
    return q.select("model", date_str("day").alias("day"), "factor", (F.round("q", 6) + 0.0).alias("q"))


def basis_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P pinv(P) A over the 28-day window: the low-rank image of the panel."""
    inp = ev_inputs(spark, sf_dir)
    basis, _ = _station_params(spark, inp, FC.STATION_SERIES)
    q = lowrank.project(FC.station_panel(inp, O.EV_FORECAST_START), lowrank.projection_weights(basis))
    rec = lowrank.reconstruct_panel(q, basis)
    return rec.select("model", "entity", date_str("day").alias("day"), (F.round("value", 6) + 0.0).alias("value"))


def forecast_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.STATION_SERIES)
    return FC.predict_stations_flow(inp, O.EV_FORECAST_START, basis, coef)


def forecast_station_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.STATION_SERIES)
    return FC.predict_single_station_flow(inp, O.EV_STATION, O.EV_FORECAST_START, basis, coef,
                                          n=O.FORECAST_STEPS)


def forecast_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _section_params(spark, inp)
    return FC.predict_section_flow(inp, O.EV_LINE, O.EV_FORECAST_START, basis, coef)


def bridge_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Event inputs with the section bridge read from its JSON file (A5)."""
    return ev_inputs(spark, sf_dir).with_(section_bridge=sections.read_section_bridge(spark, TD.section_json(spark)))


def forecast_sections_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12 with sections from the bridge, one of them without basis row."""
    inp = bridge_inputs(spark, sf_dir)
    secs = FC.section_list(inp).where(F.col("entity") != O.BARE_SECTION)
    basis = TD.fixture_basis(FC.model_entities(secs, "entity", FC.SECTION_MODELS))
    coef = TD.fixture_ar_coef(spark, list(FC.SECTION_MODELS))
    return FC.predict_section_flow(inp, O.EV_LINE, O.EV_FORECAST_START, basis, coef)


def forecast_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.PEAK_SERIES)
    return FC.predict_peak_flow(inp, O.EV_FORECAST_START, basis, coef)


REFRESH_DAY = "2024-01-10"
STREAM_FILES = 4                          # micro-batches of the streaming check
STREAM_ROW_GROUP = 2 << 20                # bytes of a row group in their files
TRIP_COLUMNS = ["time_in", "time_out", "station_in", "station_out", "line_in", "line_out"]
OD_FORECAST_START = O.OD_FORECAST_START


def _od_panel(inp: Inputs) -> DataFrame:
    history = (dt.date.fromisoformat(OD_FORECAST_START) - dt.date.fromisoformat(O.OD_START)).days
    return FC.station_panel(inp, OD_FORECAST_START, window=history)


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.trip_rollup(ev_inputs(spark, sf_dir).trips)
    return r.withColumn("day", date_str("day"))


_ROLLUPS: dict[tuple, str] = {}


def _rollup(spark: SparkSession, sf_dir: str, kind: str = "ev", grain: str = "day") -> DataFrame:
    """The stored rollup of a trip view, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind, grain)
    if key not in _ROLLUPS:
        path = scratch_path(spark, f"rollup-{kind}")
        R.write_rollup(R.trip_rollup(TD.stored_trips(spark, sf_dir, kind)), path, grain)
        _ROLLUPS[key] = path
    return R.read_rollup(spark, _ROLLUPS[key])


def day_type_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    workdays = ev_inputs(spark, sf_dir).workdays
    return _round(R.day_type_flow_from_rollup(_rollup(spark, sf_dir), workdays, O.EV_START, O.EV_END))


def forecast_total_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = R.daily_from_rollup(_rollup(spark, sf_dir), *trailing_window(O.EV_FORECAST_START, series.TREND_LAG))
    return FC.predict_total_flow(ev_inputs(spark, sf_dir), O.EV_FORECAST_START, O.FORECAST_STEPS,
                                 TD.FIXTURE_TOTAL, daily=daily)


def _panel_from_rollup(spark: SparkSession, sf_dir: str, spec: dict) -> DataFrame:
    return R.station_days_from_rollup(_rollup(spark, sf_dir), *trailing_window(O.EV_FORECAST_START, O.WINDOW), spec)


def forecast_stations_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.STATION_SERIES)
    return FC.predict_stations_flow(inp, O.EV_FORECAST_START, basis, coef,
                                    panel=_panel_from_rollup(spark, sf_dir, FC.STATION_SERIES))


def forecast_peak_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.PEAK_SERIES)
    return FC.predict_peak_flow(inp, O.EV_FORECAST_START, basis, coef,
                                panel=_panel_from_rollup(spark, sf_dir, FC.PEAK_SERIES))


def rollup_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup written before one day's trips had arrived, then refreshed on
    the days these trips count on: equal to the rollup of all trips."""
    trips = ev_inputs(spark, sf_dir).trips
    late = F.to_date("time_in") == F.lit(D.as_date(REFRESH_DAY))
    path = scratch_path(spark, "rollup-refresh")
    R.write_rollup(R.trip_rollup(trips.where(~late)), path)
    R.refresh_rollup(trips, path, R.event_days(trips.where(late)))
    return R.read_rollup(spark, path).drop("month").withColumn("day", date_str("day"))


def _refresh_withdrawn(spark: SparkSession, trips: DataFrame, day: str, grain: str) -> DataFrame:
    """A rollup of all trips, refreshed after every trip touching ``day`` was
    withdrawn: the day is empty, days these trips also touched lose theirs."""
    gone = (F.to_date("time_in") == F.lit(D.as_date(day))) | (F.to_date("time_out") == F.lit(D.as_date(day)))
    path = scratch_path(spark, "rollup-withdrawn")
    R.write_rollup(R.trip_rollup(trips), path, grain)
    R.refresh_rollup(trips.where(~gone), path, R.event_days(trips.where(gone)))
    return R.read_rollup(spark, path).drop("month").withColumn("day", date_str("day"))


def rollup_refresh_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refresh_withdrawn(spark, ev_inputs(spark, sf_dir).trips, O.WITHDRAWN_DAY, "day")


def rollup_refresh_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the order history, in a table partitioned by month."""
    return _refresh_withdrawn(spark, od_inputs(spark, sf_dir).trips, O.OD_WITHDRAWN_DAY, "month")


def stations_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = _rollup(spark, sf_dir)
    return R.stations_flow_from_rollup(rollup, O.EV_START, O.EV_END)


def peak_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = _rollup(spark, sf_dir)
    return R.peak_flow_from_rollup(rollup, O.EV_START, O.EV_END)


def month_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = D.month_bounds(O.EV_MONTH)
    rollup = _rollup(spark, sf_dir)
    return R.month_flow_from_rollup(rollup, lo, hi)


def station_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = _rollup(spark, sf_dir)
    return R.station_flow_from_rollup(rollup, O.EV_STATION, O.EV_START, O.EV_END)


def section_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = ev_inputs(spark, sf_dir)
    od = R.od_flow_from_rollup(_rollup(spark, sf_dir), O.EV_START, O.EV_END)
    return Q.section_flow(inp, O.EV_LINE, O.EV_START, O.EV_END, od=od)


def line_flow_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = _rollup(spark, sf_dir, "od", grain="month")   # 10 years
    return R.line_flow_from_rollup(rollup, O.OD_START, O.OD_END)


def _write_stream_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The trips as ``STREAM_FILES`` files of small row groups, so that several
    tasks share the one file of a micro-batch. The streams need no other view."""
    trips = TD.stored_trips(spark, sf_dir, "ev").select(*TRIP_COLUMNS)
    trips.repartition(STREAM_FILES, F.xxhash64(*TRIP_COLUMNS)).write.option("parquet.block.size", STREAM_ROW_GROUP).parquet(path)


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip files -> one micro-batch per file, in the order of a hash and not
    of time -> summed partial counts."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("trips-src", "rollup-sink", "rollup-ckpt"))
    _write_stream_files(spark, sf_dir, src)
    R.stream_rollup(spark, src, sink, ckpt, max_files_per_trigger=1).awaitTermination()
    return R.read_stream_rollup(spark, sink).drop("month").withColumn("day", date_str("day"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time hours over trip files in the order of a hash: what was closed
    by the watermark and what came late add up to the rollup of all trips."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("windows-src", "windows-sink", "windows-ckpt"))
    _write_stream_files(spark, sf_dir, src)
    R.stream_windows(spark, src, sink, ckpt, delay_hours=240, max_files_per_trigger=1).awaitTermination()
    R.close_windows(spark, sink)
    rows = R.read_windows(spark, sink, (R.CLOSED, R.LATE))
    return rows.groupBy(*R.ROLLUP_KEYS).agg(F.sum("n").alias("n")).withColumn("day", date_str("day"))


def fit_total_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler + regression on the whole order history; returns the raw weights."""
    model = FIT.fit_total_model(od_inputs(spark, sf_dir), O.OD_START, O.OD_TRAIN_END)
    return _round(FIT.coefficient_table(spark, FIT.total_coefficients(model)))


def fit_total_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pipeline saved, loaded again (A7), and its weights written and
    read as a parameter table."""
    path, weights = scratch_path(spark, "model"), scratch_path(spark, "weights")
    models.save_model(FIT.fit_total_model(od_inputs(spark, sf_dir), O.OD_START, O.OD_TRAIN_END), path)
    models.write_params(FIT.coefficient_table(spark, FIT.total_coefficients(models.load_model(path))), weights)
    return _round(FIT.coefficient_table(spark, models.read_total_coef(spark, weights)))


def forecast_total_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear one-step model fitted on the order history, turned into raw
    weights and folded 7 days ahead (M1-M3 end to end)."""
    inp = od_inputs(spark, sf_dir)
    coef = FIT.total_coefficients(FIT.fit_total_model(inp, O.OD_START, O.OD_TRAIN_END))
    return FC.predict_total_flow(inp, OD_FORECAST_START, O.FORECAST_STEPS, coef)


def fit_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regression over every station's entries of the order history (M2)."""
    coef = FIT.fit_pooled_model(od_inputs(spark, sf_dir), O.OD_START, O.OD_TRAIN_END)
    return _round(FIT.coefficient_table(spark, coef))


def forecast_panel_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled model folded 7 days ahead for every station."""
    inp = od_inputs(spark, sf_dir)
    coef = FIT.fit_pooled_model(inp, O.OD_START, O.OD_TRAIN_END)
    daily = counts.station_day_counts(inp.trips, *trailing_window(OD_FORECAST_START, series.TREND_LAG), {"station_in": ("in", None)}) \
        .select(F.col("entity").alias("station"), "day", "flow")
    fc = series.recursive_forecast(daily, inp.workdays, ["station"], coef, OD_FORECAST_START, O.FORECAST_STEPS,
                                   entities=inp.stations.select(F.col("station_name").alias("station")))
    return fc.select("station", date_str("day").alias("time"), "is_workday", "flow")


def forecast_total_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted one-step model fitted on the order history, then a
    7-day recursive forecast from the day after it, the trees inside the fold."""
    inp = od_inputs(spark, sf_dir)
    model = FIT.fit_total_model(inp, O.OD_START, O.OD_TRAIN_END, regressor="gbt")
    return FC.predict_total_flow_trees(inp, OD_FORECAST_START, O.FORECAST_STEPS, models.trees_of(model))


def forecast_panel_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over all stations pooled, then every station 7 days ahead."""
    inp = od_inputs(spark, sf_dir)
    trees = models.trees_of(FIT.fit_panel_trees(inp, O.OD_START, O.OD_TRAIN_END))
    return FC.predict_panel_flow_trees(inp, OD_FORECAST_START, O.FORECAST_STEPS, trees)


def fit_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    return FIT.fit_basis(_od_panel(inp), ents, O.OD_RANK)


def fit_factor_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    return _round(FIT.fit_factor_ar(_od_panel(inp), TD.fixture_basis(ents)))


def fit_ar_one_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-lag autoregression of each factor of the fixture basis."""
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    return _round(FIT.fit_factor_ar(_od_panel(inp), TD.fixture_basis(ents), window=1))


def fit_ar_two_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    return _round(FIT.fit_factor_ar(_od_panel(inp), TD.fixture_basis(ents), window=2))


def fit_cross_one_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each factor on yesterday's values of all factors."""
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    return _round(FIT.fit_cross_factor_ar(_od_panel(inp), TD.fixture_basis(ents), window=1, reg_param=0.0))


def fit_basis_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the fitted basis columns: the identity."""
    basis = fit_basis(spark, sf_dir)
    a = basis.select("model", "entity", F.col("factor").alias("f1"), F.col("weight").alias("w1"))
    b = basis.select("model", "entity", F.col("factor").alias("f2"), F.col("weight").alias("w2"))
    dots = a.join(b, ["model", "entity"]).groupBy("model", "f1", "f2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    return dots.select("model", F.col("f1").cast("int"), F.col("f2").cast("int"), (F.round("dot", 6) + 0.0).alias("dot"))


def forecast_stations_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn basis and AR weights from the order history, then forecast the next day."""
    inp = od_inputs(spark, sf_dir)
    ents = FC.model_entities(inp.stations, "station_name", FC.STATION_SERIES)
    panel = _od_panel(inp)
    basis = FIT.fit_basis(panel, ents, O.OD_RANK)
    coef = FIT.fit_factor_ar(panel, basis)
    return FC.predict_stations_flow(inp, OD_FORECAST_START, basis, coef)


def _stations_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-history station dimension written as ``station.csv``-style
    CSV into the shared folder and read back with the CSV reader (A4)."""
    path = scratch_path(spark, "station-csv")
    dim = TD.stored_view(spark, sf_dir, "stations_od").select("id", "station_name", "line_name",
                                                                "district", "sequence")
    dim.coalesce(1).write.option("header", "true").csv(path)
    return tables.read_stations(spark, path)


def section_flow_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 with journeys that change lines, over the station graph."""
    return Q.section_flow_network(ev_inputs(spark, sf_dir), O.EV_LINE, O.EV_START, O.EV_END, TD.transfers_ev(spark, sf_dir))


def stations_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stations_from_csv(spark, sf_dir)


def section_flow_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 on the order history, sections from the CSV station dimension."""
    inp = od_inputs(spark, sf_dir).with_(stations=_stations_from_csv(spark, sf_dir))
    return Q.section_flow(inp, O.OD_LINE, O.OD_START, O.OD_END)


_BY_DAY: dict[tuple, str] = {}


def by_day_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Event inputs whose trips were written partitioned by entry day with a span table of exit days, once per session (A1)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _BY_DAY:
        path = scratch_path(spark, "trips-by-day")
        trips = ev_inputs(spark, sf_dir).trips.select(*TRIP_COLUMNS)
        tables.write_trips(trips, path)
        _BY_DAY[key] = path
    return ev_inputs(spark, sf_dir).with_(trips=tables.read_trips(spark, _BY_DAY[key], by_day=True),
                                          trip_spans=tables.read_trip_spans(spark, _BY_DAY[key]))


def month_flow_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 on trips stored under other column names."""
    path, names = scratch_path(spark, "trips-renamed"), {"station_in": "from_station", "line_in": "from_line"}
    by_day_inputs(spark, sf_dir).trips.drop("entry_day").withColumnsRenamed(names) \
        .withColumn("entry_day", F.to_date("time_in")).write.partitionBy("entry_day").parquet(path)
    return Q.single_month_flow(Inputs(tables.read_trips(spark, path, names, by_day=True)), O.EV_MONTH)


def forecast_stations_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = by_day_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.STATION_SERIES)
    return FC.predict_stations_flow(inp, O.EV_FORECAST_START, basis, coef)


def forecast_peak_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = by_day_inputs(spark, sf_dir)
    basis, coef = _station_params(spark, inp, FC.PEAK_SERIES)
    return FC.predict_peak_flow(inp, O.EV_FORECAST_START, basis, coef)


def dimensions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 and Q4 on calendar and users written and read by their readers
    (A2, A3), as JSON records and back (A10): one row per figure."""
    inp = ev_inputs(spark, sf_dir)
    users, cal = scratch_path(spark, "users"), scratch_path(spark, "workdays")
    inp.users.write.parquet(users)
    inp.workdays.write.parquet(cal)
    inp = inp.with_(users=tables.read_users(spark, users), workdays=tables.read_workdays(spark, cal))
    ages = Q.age_structure(inp).select("sex", "bin", F.col("n").cast("double").alias("value"))
    means = _round(Q.day_type_flow(inp, O.EV_START, O.EV_END)).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("sex"), F.lit(0).alias("bin"), F.col(c).alias("value"))
                            for c in ("workday", "weekend")])).alias("r")).select("r.*")
    rows = ages.union(means)
    return sinks.from_json_records(sinks.to_json_records(rows), rows.schema)


def peak_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 in the nested record shape (A8), listed again one row per item."""
    nested = records.peak_lists(Q.peak_flow(ev_inputs(spark, sf_dir), O.EV_START, O.EV_END))
    return nested.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.col(p).alias("items")) for p in ("morning", "evening")])).alias("r")) \
        .select("r.period", F.explode("r.items").alias("i")).select("period", "i.*")


def basis_from_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture basis saved as an entities x k numpy matrix, imported, and
    round-tripped through the parameter tables (A6, A7)."""
    import io
    import numpy as np
    basis, _ = _station_params(spark, ev_inputs(spark, sf_dir), {"station_in": None})
    rows = basis.orderBy("entity", "factor").collect()                  # entities x k numbers
    names = sorted({r["entity"] for r in rows})
    buffer = io.BytesIO()
    np.save(buffer, np.array([r["weight"] for r in rows]).reshape(len(names), -1))
    buffer.seek(0)
    path = scratch_path(spark, "basis")
    models.write_params(models.basis_from_npy(spark, buffer, "station_in", names), path)
    return models.read_basis(spark, path)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: per-station entries and exits over the whole event history."""
    return Q.all_stations_flow(ev_inputs(spark, FLAGSHIP_SF), O.EV_START, O.EV_END)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return transit_queries() | (LLM.queries() | {"pipeline": corpus_pipeline.run} if LLM else {})


def transit_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stations_flow": lambda s, p: Q.all_stations_flow(ev_inputs(s, p), O.EV_START, O.EV_END),
        "stations_flow_od": lambda s, p: Q.all_stations_flow(od_inputs(s, p), O.OD_START, O.OD_END),
        "month_flow": lambda s, p: Q.single_month_flow(ev_inputs(s, p), O.EV_MONTH),
        "day_type_flow": lambda s, p: _round(Q.day_type_flow(ev_inputs(s, p), O.EV_START, O.EV_END)),
        "station_flow": lambda s, p: Q.single_station_flow(ev_inputs(s, p), O.EV_STATION,
                                                           O.EV_START, O.EV_END),
        "age_structure": lambda s, p: Q.age_structure(ev_inputs(s, p)),
        "peak_flow": lambda s, p: Q.peak_flow(ev_inputs(s, p), O.EV_START, O.EV_END),
        "line_flow": lambda s, p: Q.line_to_line_flow(od_inputs(s, p), O.OD_START, O.OD_END),
        "od_flow": lambda s, p: Q.od_flow(ev_inputs(s, p), O.EV_START, O.EV_END),
        "section_flow": lambda s, p: Q.section_flow(ev_inputs(s, p), O.EV_LINE, O.EV_START, O.EV_END),
        "stations_csv": stations_csv,
        "section_flow_od": section_flow_od,
        "section_flow_network": section_flow_network,
        "section_flow_daily": lambda s, p: Q.section_flow_daily(ev_inputs(s, p), O.EV_START, O.EV_END),
        "station_day_matrix": station_day_matrix,
        "station_day_pivot": station_day_pivot,
        "od_daily_resample": od_daily_resample,
        "lag_features": lag_feature_table,
        "forecast_total": forecast_total,
        "forecast_panel": forecast_panel,
        "basis_project": basis_project,
        "basis_reconstruct": basis_reconstruct,
        "forecast_stations": forecast_stations,
        "forecast_station_7d": forecast_station_7d,
        "forecast_sections": forecast_sections,
        "forecast_peak": forecast_peak,
        "fit_total_forecast": fit_total_forecast,
        "forecast_total_fitted": forecast_total_fitted,
        "forecast_total_gbt": forecast_total_gbt,
        "forecast_panel_gbt": forecast_panel_gbt,
        "fit_basis": fit_basis,
        "fit_factor_ar": fit_factor_ar,
        "fit_ar_one_lag": fit_ar_one_lag,
        "fit_ar_two_lags": fit_ar_two_lags,
        "fit_cross_one_lag": fit_cross_one_lag,
        "fit_total_saved": fit_total_saved,
        "fit_pooled": fit_pooled,
        "forecast_panel_fitted": forecast_panel_fitted,
        "fit_basis_products": fit_basis_products,
        "forecast_stations_fitted": forecast_stations_fitted,
        "daily_rollup": daily_rollup,
        "stations_flow_from_rollup": stations_flow_from_rollup,
        "peak_flow_from_rollup": peak_flow_from_rollup,
        "month_flow_from_rollup": month_flow_from_rollup,
        "station_flow_from_rollup": station_flow_from_rollup,
        "section_flow_from_rollup": section_flow_from_rollup,
        "line_flow_from_rollup": line_flow_from_rollup,
        "month_flow_by_day": month_flow_by_day,
        "stations_flow_by_day": lambda s, p: Q.all_stations_flow(by_day_inputs(s, p), O.EV_START, O.EV_END),
        "peak_flow_by_day": lambda s, p: Q.peak_flow(by_day_inputs(s, p), O.EV_START, O.EV_END),
        "station_flow_by_day": lambda s, p: Q.single_station_flow(by_day_inputs(s, p), O.EV_STATION, O.EV_START, O.EV_END),
        "forecast_stations_by_day": forecast_stations_by_day,
        "forecast_peak_by_day": forecast_peak_by_day,
        "dimensions_round_trip": dimensions_round_trip,
        "peak_records": peak_records,
        "basis_from_numpy": basis_from_numpy,
        "section_bridge": lambda s, p: bridge_inputs(s, p).section_bridge,
        "section_flow_bridge": lambda s, p: Q.section_flow(bridge_inputs(s, p), O.EV_LINE, O.EV_START, O.EV_END),
        "section_flow_bridge_daily": lambda s, p: Q.section_flow_daily(bridge_inputs(s, p), O.EV_START, O.EV_END),
        "forecast_sections_bridge": forecast_sections_bridge,
        "day_type_flow_from_rollup": day_type_flow_from_rollup,
        "forecast_total_from_rollup": forecast_total_from_rollup,
        "forecast_stations_from_rollup": forecast_stations_from_rollup,
        "forecast_peak_from_rollup": forecast_peak_from_rollup,
        "rollup_refresh": rollup_refresh,
        "rollup_refresh_withdrawn": rollup_refresh_withdrawn,
        "rollup_refresh_month": rollup_refresh_month,
        "stream_rollup": stream_rollup,
        "stream_windows": stream_windows,
    }


def oracle_sql() -> dict[str, str]:
    more = LLM_SQL.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) \
        if LLM else {}
    return O.oracle_sql() | more
