"""The bundle of input DataFrames every query takes first."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolens.functions.dates import as_date, on_days


@dataclass(frozen=True)
class Inputs:
    """Input tables of a deployment.

    trips          time_in, time_out, station_in, station_out, line_in, line_out
    users          sex (0 male / 1 female), birth_year
    workdays       time (date), workday (1 = workday)
    stations       id, station_name (key), line_name, district, sequence
    trip_spans     entry_day, first_exit, last_exit (optional, for trips
                   partitioned by ``entry_day``: lets exit-day ranges prune)
    section_bridge line, section_id, source, target, o_station, d_station
                   (optional; without it sections are derived from the
                   station order of each line)
    """

    trips: DataFrame
    users: DataFrame | None = None
    workdays: DataFrame | None = None
    stations: DataFrame | None = None
    section_bridge: DataFrame | None = None
    trip_spans: DataFrame | None = None

    def with_(self, **kw) -> "Inputs":
        return replace(self, **kw)

    def trips_touching(self, lo, hi) -> DataFrame:
        """Trips that may enter or leave on a day of ``[lo, hi]``: the trips
        themselves, or, with a span table, the entry-day partitions of the range
        and those with exits in it, as a predicate on the partition column. One
        row per such entry day is read while the plan is built."""
        if self.trip_spans is None or "entry_day" not in self.trips.columns:
            return self.trips
        lo, hi = F.lit(as_date(lo)), F.lit(as_date(hi))
        exits = self.trip_spans.where((F.col("first_exit") <= hi) & (F.col("last_exit") >= lo)).select("entry_day").collect()
        days = [r["entry_day"] for r in exits]
        touched = F.col("entry_day").between(lo, hi) | on_days(F.col("entry_day"), [d for d in days if d is not None])
        if None in days:
            touched = touched | F.col("entry_day").isNull()
        return self.trips.where(touched)

    def require(self, *names: str) -> None:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"this query needs input table(s): {', '.join(missing)}")
