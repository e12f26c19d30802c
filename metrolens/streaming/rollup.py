"""Hourly trip rollup: batch build (A9), streaming refresh (T1) and queries
answered from it.

The reference kept finished query results in a TTL cache. Here the reusable
state is an aggregate every descriptive query can be answered from: one
row per (side, day, hour, station, line, peer station, peer line) with the
trip count, where side 'in' is keyed by the entry time and side 'out' by
the exit time. It is written partitioned by ``day`` (or ``month`` for long
histories), so a date-range query reads only its partitions. The table is
versioned (``sources.versions``): a refresh writes the days it names beside the
old ones and one manifest file switches readers over. One stream adds partial
counts that the reader sums, so nothing is late; another keeps hours open until
a watermark closes them and sets late counts aside.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from metrolens import schemas
from metrolens.functions.dates import PEAK_BANDS, as_date, date_str, on_days
from metrolens.plans.descriptive import day_type_means
from metrolens.sources import versions

ROLLUP_KEYS = ["side", "day", "hour", "station", "line", "peer_station", "peer_line"]


def _sides(trips: DataFrame) -> DataFrame:
    """Each trip as an 'in' event (entry time) and an 'out' event (exit time)."""
    ev = F.explode(F.array(
        F.struct(F.lit("in").alias("side"), F.col("time_in").alias("ts"),
                 F.col("station_in").alias("station"), F.col("line_in").alias("line"),
                 F.col("station_out").alias("peer_station"), F.col("line_out").alias("peer_line")),
        F.struct(F.lit("out").alias("side"), F.col("time_out").alias("ts"),
                 F.col("station_out").alias("station"), F.col("line_out").alias("line"),
                 F.col("station_in").alias("peer_station"), F.col("line_in").alias("peer_line"))))
    return trips.select(ev.alias("e")).select("e.*").where(F.col("ts").isNotNull())


def trip_rollup(trips: DataFrame) -> DataFrame:
    """Batch rollup: (side, day, hour, station, line, peer_station, peer_line, n)."""
    return (_sides(trips)
            .groupBy("side", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"),
                     "station", "line", "peer_station", "peer_line")
            .agg(F.count(F.lit(1)).alias("n")))


def write_rollup(rollup: DataFrame, path: str, grain: str = "day") -> int:
    """Write a rollup partitioned by ``grain`` ("day", or "month" for long
    histories of small days) as the next version of the table; its number.
    Partitions that ``rollup`` does not hold stay as they are; to renew days
    whatever they hold, use :func:`refresh_rollup`."""
    if grain not in ("day", "month"):
        raise ValueError("grain must be 'day' or 'month'")
    return versions.write(rollup.withColumn("month", F.trunc("day", "month")).select(*schemas.ROLLUP.names), path, grain)


def refresh_rollup(trips: DataFrame, path: str, days: Sequence) -> None:
    """Renew the given event days of a rollup from ``trips``.

    A trip counts on its entry day and on its exit day, so a day's rollup
    needs every trip that enters *or* leaves on it: ``trips`` must hold all
    of these. Exactly the named days change, as one new version: a day that no
    trip touches any more becomes empty, other days keep their counts (in a
    table by month, the other days of the months concerned are taken over).
    """
    days = sorted({as_date(d) for d in days})
    if not days:
        return
    spark = trips.sparkSession
    touched = on_days(F.to_date("time_in"), days) | on_days(F.to_date("time_out"), days)
    fresh = trip_rollup(trips.where(touched)).where(on_days(F.col("day"), days)).withColumn("month", F.trunc("day", "month"))
    grain = versions.grain_of(spark, path) or "day"
    parts = [d.isoformat() for d in days]
    if grain == "month":
        parts = sorted({d.replace(day=1).isoformat() for d in days})
        held = versions.read(spark, path, schemas.ROLLUP, lo=parts[0], hi=parts[-1])
        in_parts = on_days(F.col("month"), parts)
        fresh = fresh.unionByName(held.where(in_parts & ~on_days(F.col("day"), days)))
    versions.write(fresh.select(*schemas.ROLLUP.names), path, grain, versions.REPLACE, parts)


def event_days(trips: DataFrame) -> list[dt.date]:
    """The days that trips count on (one row per day reaches the driver)."""
    return sorted(r["day"] for r in _sides(trips).select(F.to_date("ts").alias("day")).distinct().collect())


def read_rollup(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rollup as of ``version`` (default: the last one). The DataFrame stays
    on the version it was made with, whatever is written later."""
    return versions.read(spark, path, schemas.ROLLUP, version)


def _days(lo, hi) -> Column:
    lo, hi = as_date(lo), as_date(hi)
    # The month predicate is implied by the day range; it lets a
    # month-partitioned rollup prune partitions.
    return (F.col("day").between(F.lit(lo), F.lit(hi))
            & F.col("month").between(F.lit(lo.replace(day=1)), F.lit(hi.replace(day=1))))


def stations_flow_from_rollup(rollup: DataFrame, start, end, bands: dict | None = None,
                              fill: int | None = None) -> DataFrame:
    """Q6 (no bands) or Q5 (``bands``) from the rollup, same semantics as on trips."""
    periods = bands.items() if bands else [("all", None)]
    parts = []
    for period, band in periods:
        r = rollup.where(_days(start, end))
        if band is not None:
            r = r.where(F.col("hour").between(band[0], band[1]))
        parts.append(r.select(F.lit(period).alias("period"), "station", "side", "n"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    agg = (stacked.groupBy("period", "station")
           .agg(F.sum(F.when(F.col("side") == "in", F.col("n")).otherwise(0)).alias("flow_in"),
                F.sum(F.when(F.col("side") == "out", F.col("n")).otherwise(0)).alias("flow_out"))
           .where(F.col("flow_in") > 0))
    out = F.when(F.col("flow_out") > 0, F.col("flow_out"))
    if fill is not None:
        out = out.otherwise(F.lit(fill).cast("long"))
    res = agg.select("period", "station", F.col("flow_in").cast("long").alias("flow_in"),
                     out.cast("long").alias("flow_out"))
    return res if bands else res.drop("period")


def peak_flow_from_rollup(rollup: DataFrame, start, end) -> DataFrame:
    return stations_flow_from_rollup(rollup, start, end, bands=PEAK_BANDS, fill=0)


def line_flow_from_rollup(rollup: DataFrame, start, end) -> DataFrame:
    """Q7 from the rollup (entry side, entry day)."""
    return (rollup.where((F.col("side") == "in") & _days(start, end))
            .groupBy(F.col("line").alias("source"), F.col("peer_line").alias("target"))
            .agg(F.sum("n").cast("long").alias("flow")))


def od_flow_from_rollup(rollup: DataFrame, start, end) -> DataFrame:
    """OD matrix (D5) from the rollup: entry side, entry day -> (station_in, station_out, flow)."""
    return (rollup.where((F.col("side") == "in") & _days(start, end))
            .groupBy(F.col("station").alias("station_in"), F.col("peer_station").alias("station_out"))
            .agg(F.sum("n").cast("long").alias("flow")))


def station_flow_from_rollup(rollup: DataFrame, station: str, start, end) -> DataFrame:
    """Q3 from the rollup: daily entries and exits of one station."""
    return (rollup.where((F.col("station") == station) & _days(start, end))
            .groupBy(F.when(F.col("side") == "in", "in").otherwise("out").alias("direction"), "day")
            .agg(F.sum("n").cast("long").alias("flow"))
            .select(F.lit(station).alias("station"), "direction", date_str("day").alias("time"), "flow"))


def month_flow_from_rollup(rollup: DataFrame, lo, hi) -> DataFrame:
    """Q1-style daily entries from the rollup."""
    return (rollup.where((F.col("side") == "in") & _days(lo, hi))
            .groupBy("day").agg(F.sum("n").cast("long").alias("flow"))
            .select(date_str("day").alias("time"), "flow"))


def day_type_flow_from_rollup(rollup: DataFrame, workdays: DataFrame, lo, hi) -> DataFrame:
    """Q2 from the rollup: mean daily entries on workdays and on other days."""
    return day_type_means(daily_from_rollup(rollup, lo, hi), workdays)


def daily_from_rollup(rollup: DataFrame, lo, hi) -> DataFrame:
    """(time, flow): entries per day."""
    return (rollup.where((F.col("side") == "in") & _days(lo, hi))
            .groupBy(F.col("day").alias("time")).agg(F.sum("n").cast("long").alias("flow")))


def station_days_from_rollup(rollup: DataFrame, lo, hi, series: dict) -> DataFrame:
    """(model, entity, day, flow) like :func:`counts.station_day_counts`:
    ``series`` maps a name to ("in" | "out", hour band or None)."""
    tags = []
    for name, (side, band) in series.items():
        cond = F.col("side") == side
        if band is not None:
            cond = cond & F.col("hour").between(band[0], band[1])
        tags.append(F.when(cond, F.lit(name)))
    return (rollup.where(_days(lo, hi) & F.col("station").isNotNull())
            .select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("model"),
                    F.col("station").alias("entity"), "day", "n")
            .groupBy("model", "entity", "day").agg(F.sum("n").cast("double").alias("flow")))


# --- streaming refresh

MOST_FOLDERS = 8          # writes that a day may consist of before it is compacted


def _trigger(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _source(spark: SparkSession, source_path: str, max_files_per_trigger: int | None) -> DataFrame:
    src = spark.readStream.schema(schemas.TRIPS)
    if max_files_per_trigger:
        src = src.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return src.parquet(source_path)


def _summed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*ROLLUP_KEYS, "month", *more).agg(F.sum("n").cast("long").alias("n"))


def stream_rollup(spark: SparkSession, source_path: str, sink_path: str, checkpoint_path: str,
                  max_files_per_trigger: int | None = None, available_now: bool = True,
                  most_folders: int = MOST_FOLDERS) -> StreamingQuery:
    """Maintain the rollup from trip files as they arrive.

    Trip files (TRIPS schema) under ``source_path`` are read as a stream. Each
    micro-batch is counted and added to a versioned table, partitioned by day;
    the manifest notes the batch, so a batch that is run again after a failure
    is not counted twice. A day that consists of more than ``most_folders``
    writes is compacted. There is no state and no watermark: events may arrive
    in any order and any number of days late, and the current hour is visible
    at once. ``read_stream_rollup`` sums the partial counts.
    """
    def batch(trips: DataFrame, number: int) -> None:
        own = trips.sparkSession
        note = f"{checkpoint_path}#{number}"
        if not versions.manifest(own, sink_path).where(F.col("note") == note).isEmpty():
            return
        counted = trip_rollup(trips).withColumn("month", F.trunc("day", "month"))
        versions.write(counted.select(*schemas.ROLLUP.names), sink_path, "day", versions.ADD, note=note)
        versions.compact(own, sink_path, schemas.ROLLUP, most_folders, _summed)

    return _trigger(_source(spark, source_path, max_files_per_trigger).writeStream.foreachBatch(batch)
                    .option("checkpointLocation", checkpoint_path), available_now)


def read_stream_rollup(spark: SparkSession, sink_path: str) -> DataFrame:
    """The rollup as of the last committed batch; a filter on ``day`` prunes partitions."""
    return _summed(versions.read(spark, sink_path, schemas.ROLLUP)).select(*schemas.ROLLUP.names)


# --- event-time windows with a late side

_SLOTS = T.StructType([*schemas.ROLLUP.fields, T.StructField("slot", T.StringType())])
OPEN, CLOSED, LATE = "open", "closed", "late"


def _slot(kind: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.col("day").cast("string"))


def stream_windows(spark: SparkSession, source_path: str, sink_path: str, checkpoint_path: str, delay_hours: int = 24,
                   max_files_per_trigger: int | None = None, available_now: bool = True,
                   most_folders: int = MOST_FOLDERS) -> StreamingQuery:
    """Hourly counts that are final once their hour is closed, and a side output
    of what came too late.

    The watermark is the latest event time seen less ``delay_hours``. Counts of
    hours that end after it are kept open and added up batch by batch; an hour
    is closed, and from then on never changes, as soon as the watermark reaches
    its end; counts of hours that were closed before the batch go to the late
    side. (Spark's own watermark would drop these rows.) A batch changes all
    three in one manifest entry, which also holds the watermark, so a batch that
    fails leaves nothing behind, and one that is run again changes nothing. Open
    hours, the only state, are rewritten with every batch; a day of closed or
    late counts that consists of more than ``most_folders`` writes is compacted.
    """
    def batch(trips: DataFrame, number: int) -> None:
        own = trips.sparkSession
        note = f"{checkpoint_path}#{number}"
        if not versions.manifest(own, sink_path).where(F.col("note").startswith(note + "@")).isEmpty():
            return
        before = _watermark(own, sink_path)
        events = _sides(trips)
        latest = events.agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("t")).collect()[0]["t"]   # one value
        now = before if latest is None else max(before, latest - delay_hours * 3600)
        counted = trip_rollup(trips).withColumn("month", F.trunc("day", "month"))
        _advance(own, sink_path, counted, before, now, f"{note}@{now}", most_folders)

    return _trigger(_source(spark, source_path, max_files_per_trigger).writeStream.foreachBatch(batch)
                    .option("checkpointLocation", checkpoint_path), available_now)


def _watermark(spark: SparkSession, sink_path: str) -> int:
    note = versions.last_note(spark, sink_path)
    return int(note.rsplit("@", 1)[1]) if note else -2**62


def _advance(spark: SparkSession, sink_path: str, counted: DataFrame, before: int, now: int, note: str, most_folders: int) -> None:
    ends = F.unix_timestamp(F.col("day").cast("timestamp")) + (F.col("hour") + 1) * 3600
    held = versions.read(spark, sink_path, _SLOTS, lo=f"{OPEN}-", hi=f"{OPEN}-~")
    kept = held.withColumn("kind", F.lit(OPEN)).drop("slot").unionByName(
        counted.withColumn("kind", F.when(ends <= before, LATE).otherwise(OPEN)))
    rows = _summed(kept, "kind")
    kind = F.when(F.col("kind") == LATE, LATE).when(ends <= now, CLOSED).otherwise(OPEN)
    was_open = versions.live_parts(versions.manifest(spark, sink_path)).where(F.col("part").startswith(f"{OPEN}-")).select("part").distinct()
    action = F.when(F.col("part").startswith(f"{OPEN}-"), versions.REPLACE).otherwise(versions.ADD)
    versions.write(rows.withColumn("slot", _slot(kind)).select(*_SLOTS.names), sink_path, "slot", action,
                   [r["part"] for r in was_open.collect()], note)                           # the open days
    versions.compact(spark, sink_path, _SLOTS, most_folders, lambda df: _summed(df, "slot"))


def close_windows(spark: SparkSession, sink_path: str) -> None:
    """End of the stream: close the hours that are still open."""
    empty = spark.createDataFrame([], schemas.ROLLUP)
    _advance(spark, sink_path, empty, _watermark(spark, sink_path), 2**61, f"closed@{2**61}", MOST_FOLDERS)


def read_windows(spark: SparkSession, sink_path: str, kinds: Sequence[str] = (CLOSED,)) -> DataFrame:
    """(kind, rollup columns) of the sink: closed hours, and if asked for the
    late counts of closed hours and the open hours so far."""
    parts = [versions.read(spark, sink_path, _SLOTS, lo=f"{k}-", hi=f"{k}-~") for k in kinds]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kind = F.split_part("slot", F.lit("-"), F.lit(1)).alias("kind")
    return _summed(rows.select(*schemas.ROLLUP.names, kind), "kind").select("kind", *schemas.ROLLUP.names)
