"""Trip counting operators.

Every count is a partial + final hash aggregation, so a hot station or day
is combined map-side before the shuffle; the shuffled data is at most
(groups x partitions) rows, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolens.functions.dates import entered, in_days, in_hour_band


def _nonnull(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def daily_counts(trips: DataFrame, ts_col: str, lo, hi, where: Column | None = None) -> DataFrame:
    """Count of trips per calendar day of ``ts_col`` in ``[lo, hi]`` -> (time, flow)."""
    cond = entered(trips, lo, hi) if ts_col == "time_in" else in_days(ts_col, lo, hi)
    if where is not None:
        cond = cond & where
    return (trips.where(cond).groupBy(F.to_date(ts_col).alias("time"))
            .agg(F.count(F.lit(1)).alias("flow")))


def station_in_out(trips: DataFrame, lo, hi, bands: dict[str, tuple[int, int]] | None = None,
                   fill: int | None = None) -> DataFrame:
    """Entries and exits per station (and per hour band) in one scan.

    Entries are counted on the entry day, exits on the exit day; each trip
    contributes at most one entry tag and one exit tag, stacked with
    ``explode`` and summed per (period, station) with conditional counts.
    The result is anchored on entries (a station with exits only is left
    out) and ``flow_out`` is ``fill`` where a station has no exit - the
    reference's left merge of an in-table and an out-table. Null stations
    form their own group, as they did there.
    """
    in_ok = in_days("time_in", lo, hi)
    out_ok = in_days("time_out", lo, hi)
    periods = bands.items() if bands else [("all", None)]
    tags = []
    for period, band in periods:
        c_in = in_ok if band is None else in_ok & in_hour_band("time_in", band)
        c_out = out_ok if band is None else out_ok & in_hour_band("time_out", band)
        tags.append(F.when(c_in, F.struct(F.lit(period).alias("period"),
                                          F.col("station_in").alias("station"),
                                          F.lit(True).alias("is_in"))))
        tags.append(F.when(c_out, F.struct(F.lit(period).alias("period"),
                                           F.col("station_out").alias("station"),
                                           F.lit(False).alias("is_in"))))
    stacked = (trips.where(in_ok | out_ok)
               .select(F.explode(_nonnull(F.array(*tags))).alias("t"))
               .select("t.*"))
    agg = (stacked.groupBy("period", "station")
           .agg(F.count_if("is_in").alias("flow_in"), F.count_if(~F.col("is_in")).alias("flow_out"))
           .where(F.col("flow_in") > 0))
    # A zero exit count means the station was absent from the out-table.
    out = F.when(F.col("flow_out") > 0, F.col("flow_out"))
    if fill is not None:
        out = out.otherwise(F.lit(fill).cast("long"))
    return agg.select("period", "station", "flow_in", out.alias("flow_out"))


def station_day_counts(trips: DataFrame, lo, hi, series: dict[str, tuple[str, tuple[int, int] | None]]
                       ) -> DataFrame:
    """Counts per (series, station, day) for several series in one scan.

    ``series`` maps a series name to ``("in" | "out", hour band or None)``;
    an "in" series counts entries by entry day, "out" exits by exit day.
    """
    in_ok = in_days("time_in", lo, hi)
    out_ok = in_days("time_out", lo, hi)
    tags = []
    for name, (side, band) in series.items():
        ts, st, ok = ("time_in", "station_in", in_ok) if side == "in" else ("time_out", "station_out", out_ok)
        cond = ok if band is None else ok & in_hour_band(ts, band)
        tags.append(F.when(cond, F.struct(F.lit(name).alias("model"), F.col(st).alias("entity"),
                                          F.to_date(ts).alias("day"))))
    return (trips.where(in_ok | out_ok)
            .select(F.explode(_nonnull(F.array(*tags))).alias("t")).select("t.*")
            .where(F.col("entity").isNotNull())
            .groupBy("model", "entity", "day").agg(F.count(F.lit(1)).alias("flow")))


def od_counts(trips: DataFrame, lo, hi, by_day: bool = False) -> DataFrame:
    """Origin-destination matrix (D5), or OD cube per entry day."""
    keys = [F.col("station_in"), F.col("station_out")]
    if by_day:
        keys.append(F.to_date("time_in").alias("day"))
    return (trips.where(entered(trips, lo, hi)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("flow")))
