"""Descriptive queries Q1-Q8 (plus the OD matrix they build on).

Each function returns a lazy DataFrame in long form; ``to_nested`` in
``metrolens.sources.sinks`` regroups any of them into the nested record
shape of the original API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolens.functions.dates import PEAK_BANDS, as_date, date_str, entered, in_days, month_bounds
from metrolens.functions.numeric import AGE_BIN_COUNT, age, age_bin
from metrolens.operators import counts, network, sections
from metrolens.plans.inputs import Inputs

# Fixed value: the reference computes ages against this year.
DEFAULT_BASE_YEAR = 2021


def single_month_flow(inp: Inputs, time_ym: str) -> DataFrame:
    """Q1: trips per entry day of one month -> (time, flow), by day."""
    lo, hi = month_bounds(time_ym)
    daily = counts.daily_counts(inp.trips, "time_in", lo, hi)
    return daily.select(date_str("time").alias("time"), "flow").orderBy("time")


def day_type_flow(inp: Inputs, start, end) -> DataFrame:
    """Q2: mean daily entries on workdays and on other days -> (workday, weekend).

    Only days with trips count (days without trips do not exist). A day
    missing from the calendar (or with a null flag) is in neither group,
    and an empty group is 0.
    """
    inp.require("workdays")
    return day_type_means(counts.daily_counts(inp.trips, "time_in", start, end), inp.workdays)


def day_type_means(daily: DataFrame, workdays: DataFrame) -> DataFrame:
    """(workday, weekend) means of daily flows (time, flow)."""
    cal = workdays.select("time", (F.col("workday") == 1).alias("is_workday"))
    # The calendar has one row per day; AQE broadcasts it from its runtime size.
    tagged = daily.join(cal, "time", "left")
    return tagged.agg(
        F.coalesce(F.avg(F.when(F.col("is_workday"), F.col("flow"))), F.lit(0.0)).alias("workday"),
        F.coalesce(F.avg(F.when(~F.col("is_workday"), F.col("flow"))), F.lit(0.0)).alias("weekend"))


def single_station_flow(inp: Inputs, station: str, start, end) -> DataFrame:
    """Q3: daily entries and exits of one station -> (station, direction, time, flow).

    One scan: a trip can tag an entry ('in', entry day) and an exit ('out',
    exit day) of the station; both are counted in the same aggregation.
    """
    c_in = (F.col("station_in") == station) & in_days("time_in", start, end)
    c_out = (F.col("station_out") == station) & in_days("time_out", start, end)
    tags = F.array(F.when(c_in, F.struct(F.lit("in").alias("direction"), F.to_date("time_in").alias("time"))),
                   F.when(c_out, F.struct(F.lit("out").alias("direction"), F.to_date("time_out").alias("time"))))
    stacked = (inp.trips_touching(start, end).where(c_in | c_out)
               .select(F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("t")).select("t.*"))
    return (stacked.groupBy("direction", "time").agg(F.count(F.lit(1)).alias("flow"))
            .select(F.lit(station).alias("station"), "direction", date_str("time").alias("time"), "flow")
            .orderBy("direction", "time"))


def age_structure(inp: Inputs, base_year: int = DEFAULT_BASE_YEAR) -> DataFrame:
    """Q4: users per sex and age decade -> (sex, bin, n), all 10 bins for both sexes.

    ``bin`` b covers ages (10(b-1), 10b]. Grouping happens on (sex, bin)
    directly, so the shuffle carries at most 20 partial counts per task.
    """
    inp.require("users")
    binned = inp.users.select("sex", age_bin(age("birth_year", base_year)).alias("bin"))
    n = (binned.where(F.col("sex").isin(0, 1) & F.col("bin").isNotNull())
         .groupBy("sex", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = (n.sparkSession.range(1)
            .select(F.explode(F.array(F.lit(0), F.lit(1))).alias("sex"))
            .select("sex", F.explode(F.sequence(F.lit(1), F.lit(AGE_BIN_COUNT))).alias("bin")))
    return (grid.join(n, ["sex", "bin"], "left")
            .select(F.when(F.col("sex") == 0, "male").otherwise("female").alias("sex"),
                    F.col("bin").cast("int").alias("bin"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .orderBy("sex", "bin"))


def peak_flow(inp: Inputs, start, end, fill: int | None = 0) -> DataFrame:
    """Q5: entries and exits per station in the morning and evening peaks
    -> (period, station, flow_in, flow_out); a missing exit count is ``fill``.
    Row order is unspecified, as in the reference."""
    return counts.station_in_out(inp.trips_touching(start, end), start, end, bands=PEAK_BANDS, fill=fill)


def all_stations_flow(inp: Inputs, start, end, fill: int | None = None) -> DataFrame:
    """Q6: entries and exits per station -> (station, flow_in, flow_out).

    Stations with exits only are left out; a missing exit count stays
    null unless ``fill`` is given. Row order is unspecified, as in the
    reference.
    """
    return counts.station_in_out(inp.trips_touching(start, end), start, end, fill=fill).drop("period")


def line_to_line_flow(inp: Inputs, start, end) -> DataFrame:
    """Q7: trips per (entry line, exit line), same-line pairs included
    (row order unspecified, as in the reference)."""
    return (inp.trips.where(entered(inp.trips, start, end))
            .groupBy(F.col("line_in").alias("source"), F.col("line_out").alias("target"))
            .agg(F.count(F.lit(1)).alias("flow")))


def od_flow(inp: Inputs, start, end) -> DataFrame:
    """OD matrix (D5): trips per (station_in, station_out) by entry day."""
    return counts.od_counts(inp.trips, start, end)


def section_flow(inp: Inputs, line: str, start, end, od: DataFrame | None = None) -> DataFrame:
    """Q8: up and down flow of every section of ``line``
    -> (direction, section_id, source, target, flow), zero-flow sections kept.

    With a bridge table the listed OD pairs are summed; without one the
    sections and their pairs follow from the station order of the line.
    ``od`` (station_in, station_out, flow) may be given, e.g. read from the
    rollup; by default it is counted from the trips.
    """
    if od is None:
        od = counts.od_counts(inp.trips, start, end)
    if inp.section_bridge is not None:
        flows = sections.bridge_flows(od, inp.section_bridge.where(F.col("line") == line))
    else:
        inp.require("stations")
        # Journeys of other lines cannot cross this line's sections.
        flows = sections.sequence_flows(od, inp.stations.where(F.col("line_name") == line))
    return (flows.where(F.col("line") == line)
            .select("direction", "section_id", "source", "target", "flow")
            .orderBy("direction", "section_id"))


def section_flow_network(inp: Inputs, line: str, start, end, transfers: DataFrame | None = None,
                         od: DataFrame | None = None) -> DataFrame:
    """Q8 with journeys across lines, each along the shortest path of the station
    graph, without a bridge file -> (direction, section_id, source, target, flow).
    ``transfers`` (a, b): stations between which passengers change; by default
    those of different lines that share an id."""
    inp.require("stations")
    if od is None:
        od = counts.od_counts(inp.trips, start, end)
    return (network.network_flows(od, inp.stations, transfers).where(F.col("line") == line)
            .select("direction", "section_id", "source", "target", "flow").orderBy("direction", "section_id"))


def section_flow_daily(inp: Inputs, start, end) -> DataFrame:
    """Section x day flows of every line (C4/D14), zero-filled over ``[start, end]``
    -> (line, section_id, source, target, direction, day, flow)."""
    od = counts.od_counts(inp.trips, start, end, by_day=True)
    if inp.section_bridge is not None:
        flows = sections.bridge_flows(od, inp.section_bridge, keys=["day"])
        secs = inp.section_bridge.select("line", "section_id", "source", "target").distinct()
        grid = (secs.select("*", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"))
                .withColumn("day", F.explode(F.sequence(F.lit(as_date(start)), F.lit(as_date(end))))))
        keys = ["line", "section_id", "source", "target", "direction", "day"]
        flows = grid.join(flows, keys, "left").select(*keys, F.coalesce("flow", F.lit(0)).cast("long").alias("flow"))
    else:
        inp.require("stations")
        flows = sections.sequence_flows(od, inp.stations, day_range=(start, end))
    return flows.select("line", "section_id", "source", "target", "direction",
                        date_str("day").alias("day"), "flow")
