"""Forecast queries Q9-Q13.

The reference scored pre-trained artefacts (a scaler + regressor for the
total series; a k=64 basis and a sequence network per entity panel). Here
the same pipelines run on Spark with parameters passed as tables:

* total flow (Q9): a linear one-step model on the reference's eight
  features, folded recursively (``series.recursive_forecast``);
* entity panels (Q10-Q13): basis projection, per-factor autoregression and
  reconstruction (``lowrank.low_rank_forecast``), one job for all models.

``metrolens.plans.fit`` learns those parameters from trips.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolens.functions.dates import PEAK_BANDS, date_str, forward_window, trailing_window
from metrolens.operators import counts, lowrank, sections, series
from metrolens.plans.inputs import Inputs

# Model names of the entity panels (one basis + AR coefficients each).
STATION_SERIES = {"station_in": ("in", None), "station_out": ("out", None)}
PEAK_SERIES = {f"peak_{p}_{side}": (side, band) for p, band in PEAK_BANDS.items() for side in ("in", "out")}
SECTION_MODELS = ("section_up", "section_down")


def station_panel(inp: Inputs, start, series_spec: Mapping = STATION_SERIES,
                  window: int = lowrank.WINDOW_DAYS) -> DataFrame:
    """(model, entity, day, flow) station counts in ``[start - window, start - 1]``, sparse."""
    lo, hi = trailing_window(start, window)
    return (counts.station_day_counts(inp.trips_touching(lo, hi), lo, hi, dict(series_spec))
            .select("model", "entity", "day", F.col("flow").cast("double").alias("flow")))


def section_list(inp: Inputs) -> DataFrame:
    """(line, section_id, source, target, entity) of every section."""
    if inp.section_bridge is not None:
        secs = inp.section_bridge.select("line", "section_id", "source", "target").distinct()
    else:
        inp.require("stations")
        secs = sections.sequence_sections(inp.stations).drop("b")
    return secs.withColumn("entity", F.concat_ws("/", "line", F.col("section_id").cast("string")))


def section_panel(inp: Inputs, start, window: int = lowrank.WINDOW_DAYS) -> DataFrame:
    """(model, entity, day, flow) per section and direction (sparse; zero cells absent)."""
    lo, hi = trailing_window(start, window)
    od = counts.od_counts(inp.trips, lo, hi, by_day=True)
    if inp.section_bridge is not None:
        flows = sections.bridge_flows(od, inp.section_bridge, keys=["day"])
    else:
        inp.require("stations")
        flows = sections.sequence_flows(od, inp.stations, day_range=(lo, hi))
    return flows.where(F.col("flow") != 0).select(
        F.concat(F.lit("section_"), "direction").alias("model"),
        F.concat_ws("/", "line", F.col("section_id").cast("string")).alias("entity"),
        "day", F.col("flow").cast("double").alias("flow"))


def model_entities(entities: DataFrame, entity_col: str, models) -> DataFrame:
    """(model, entity) for each model over one entity table - a generator, not a join."""
    return entities.select(F.col(entity_col).alias("entity"),
                           F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))


def _total_daily(inp: Inputs, start, daily: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The one total series, and its entity table: it is forecast even when
    the window has no trip at all."""
    if daily is None:
        lo, hi = trailing_window(start, series.TREND_LAG)
        daily = counts.daily_counts(inp.trips, "time_in", lo, hi)
    total = daily.select(F.lit("total").alias("series"), F.col("time").alias("day"), "flow")
    return total, daily.sparkSession.range(1).select(F.lit("total").alias("series"))


def predict_total_flow(inp: Inputs, start, n: int, coef: Mapping[str, float],
                       daily: DataFrame | None = None) -> DataFrame:
    """Q9: n-day forecast of total entries -> (time, is_workday, flow).
    ``daily`` (time, flow) may be given, e.g. read from the rollup."""
    total, one = _total_daily(inp, start, daily)
    fc = series.recursive_forecast(total, inp.workdays, ["series"], coef, start, n, entities=one)
    return fc.select(date_str("day").alias("time"), "is_workday", "flow").orderBy("time")


def predict_total_flow_model(inp: Inputs, start, n: int, model) -> DataFrame:
    """Q9 with any fitted one-step Spark ML pipeline (e.g. scaler + GBT),
    scored recursively -> (time, is_workday, flow)."""
    total, one = _total_daily(inp, start, None)
    fc = series.recursive_forecast_model(total, inp.workdays, ["series"], model, start, n, entities=one)
    return fc.select(date_str("day").alias("time"), "is_workday", "flow").orderBy("time")


def predict_total_flow_trees(inp: Inputs, start, n: int, trees: series.Trees) -> DataFrame:
    """Q9 with a fitted tree ensemble walked inside the fold -> (time, is_workday, flow)."""
    total, one = _total_daily(inp, start, None)
    fc = series.recursive_forecast_trees(total, inp.workdays, ["series"], trees, start, n, entities=one)
    return fc.select(date_str("day").alias("time"), "is_workday", "flow").orderBy("time")


def predict_panel_flow_trees(inp: Inputs, start, n: int, trees: series.Trees) -> DataFrame:
    """The same for the entries of every station -> (station, time, is_workday, flow)."""
    inp.require("stations")
    lo, hi = trailing_window(start, series.TREND_LAG)
    daily = counts.station_day_counts(inp.trips_touching(lo, hi), lo, hi, {"station_in": ("in", None)})
    names = inp.stations.select(F.col("station_name").alias("station")).where("station IS NOT NULL")
    fc = series.recursive_forecast_trees(daily.select(F.col("entity").alias("station"), "day", "flow"), inp.workdays, ["station"],
                                         trees, start, n, entities=names)
    return fc.select("station", date_str("day").alias("time"), "is_workday", "flow")


def _complete(inp: Inputs, fc: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``fc`` (station, ..., flows) with a row for every station of the
    dimension; a station without basis row gets 0. ``keys`` adds further key
    columns to each station."""
    if inp.stations is None:
        return fc
    names = inp.stations.select(F.col("station_name").alias("station")).where("station IS NOT NULL").distinct()
    if keys is not None:
        names = names.withColumn("_k", F.explode(keys)).select("station", "_k.*")
    flows = [c for c in fc.columns if c.startswith("flow")]
    return names.join(fc, names.columns, "left").select(*[c for c in fc.columns if c not in flows],
                                                        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in flows])


def _by_station(fc: DataFrame, in_model: str, out_model: str) -> DataFrame:
    return (fc.groupBy(F.col("entity").alias("station"))
            .agg(F.max(F.when(F.col("model") == in_model, F.col("flow"))).alias("flow_in"),
                 F.max(F.when(F.col("model") == out_model, F.col("flow"))).alias("flow_out")))


def predict_stations_flow(inp: Inputs, start, basis: DataFrame, coef: DataFrame,
                          panel: DataFrame | None = None) -> DataFrame:
    """Q10: next-day entries and exits of every station -> (station, flow_in, flow_out).
    ``panel`` may be given, e.g. read from the rollup."""
    panel = station_panel(inp, start) if panel is None else panel
    b = basis.where(F.col("model").isin(*STATION_SERIES))
    fc = lowrank.low_rank_forecast(panel, b, coef, start, 1)
    return _complete(inp, _by_station(fc, "station_in", "station_out")).orderBy("station")


def predict_single_station_flow(inp: Inputs, station: str, start, basis: DataFrame, coef: DataFrame,
                                n: int = 7, panel: DataFrame | None = None) -> DataFrame:
    """Q11: n-day entries and exits of one station -> (station, direction, time, flow).

    The recursion couples all stations (each step re-projects the whole
    forecast), so every station is forecast and one is reported.
    """
    panel = station_panel(inp, start) if panel is None else panel
    b = basis.where(F.col("model").isin(*STATION_SERIES))
    fc = (lowrank.low_rank_forecast(panel, b, coef, start, n).where(F.col("entity") == station)
          .select(F.col("entity").alias("station"),
                  F.when(F.col("model") == "station_in", "in").otherwise("out").alias("direction"),
                  date_str("day").alias("time"), "flow"))
    only = inp.with_(stations=None if inp.stations is None else inp.stations.where(F.col("station_name") == station))
    lo, hi = forward_window(start, n)
    days = [(lo + dt.timedelta(days=i)).isoformat() for i in range((hi - lo).days + 1)]
    grid = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(t).alias("time")) for d in ("in", "out") for t in days])
    return _complete(only, fc, grid).orderBy("direction", "time")


def predict_section_flow(inp: Inputs, line: str, start, basis: DataFrame, coef: DataFrame) -> DataFrame:
    """Q12: next-day up and down flow of every section of ``line``
    -> (direction, section_id, source, target, flow); a section without basis
    row gets 0, as a station does."""
    panel = section_panel(inp, start)
    b = basis.where(F.col("model").isin(*SECTION_MODELS))
    fc = lowrank.low_rank_forecast(panel, b, coef, start, 1)
    secs = section_list(inp).where(F.col("line") == line) \
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in SECTION_MODELS])))
    return (secs.join(fc, ["model", "entity"], "left")
            .select(F.regexp_replace("model", "^section_", "").alias("direction"),
                    "section_id", "source", "target", F.coalesce("flow", F.lit(0)).cast("long").alias("flow"))
            .orderBy("direction", "section_id"))


def predict_peak_flow(inp: Inputs, start, basis: DataFrame, coef: DataFrame,
                      panel: DataFrame | None = None) -> DataFrame:
    """Q13: next-day peak entries and exits per station
    -> (period, station, flow_in, flow_out) for the morning and evening peaks."""
    panel = station_panel(inp, start, PEAK_SERIES) if panel is None else panel
    b = basis.where(F.col("model").isin(*PEAK_SERIES))
    fc = lowrank.low_rank_forecast(panel, b, coef, start, 1)
    parts = F.split("model", "_")
    by_period = (fc.select(parts.getItem(1).alias("period"), parts.getItem(2).alias("side"),
                      F.col("entity").alias("station"), "flow")
            .groupBy("period", "station")
            .agg(F.max(F.when(F.col("side") == "in", F.col("flow"))).alias("flow_in"),
                 F.max(F.when(F.col("side") == "out", F.col("flow"))).alias("flow_out")))
    periods = F.array(*[F.struct(F.lit(p).alias("period")) for p in PEAK_BANDS])
    return _complete(inp, by_period, periods).orderBy("period", "station")
