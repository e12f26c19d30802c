"""Section flows of journeys across lines, without a list of their pairs.

The station graph joins consecutive stations of a line and the stations of a
transfer; every link counts one step. From each origin a breadth-first search,
one self-join with the links per step, gives the shortest-path tree: of several
predecessors at the same distance the first by name. A journey uses the links
of its origin's tree between origin and destination, so the load of the link
into a station is the flow to all stations below it: loads are summed from the
leaves up, one level of all trees at a time, and each level is one join and one
sum. Work and storage grow with origins x stations, as the OD matrix itself
does, and never with pairs x sections. Levels are written to the shared
checkpoint folder, so that a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolens.operators.sections import sequence_sections
from metrolens.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_id_transfers(stations: DataFrame) -> DataFrame:
    """(a, b): stations of different lines that share an ``id``."""
    x = stations.select("id", F.col("station_name").alias("a"), F.col("line_name").alias("la"))
    y = stations.select("id", F.col("station_name").alias("b"), F.col("line_name").alias("lb"))
    return x.join(y, "id").where("la <> lb").select("a", "b").distinct()


def station_links(stations: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """(a, b): directed links between neighbouring stations and, both ways,
    between the stations of each transfer (default: those that share an id)."""
    rides = sequence_sections(stations).select(F.col("source").alias("a"), F.col("target").alias("b"))
    changes = same_id_transfers(stations) if transfers is None else transfers.select("a", "b")
    one_way = rides.unionByName(changes).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def shortest_path_levels(links: DataFrame, origins: DataFrame) -> list[DataFrame]:
    """One (origin, station, parent) table per distance 0, 1, ...: the
    shortest-path tree of every origin. ``origins``: (origin)."""
    links = _written(links, "links")
    levels = [_written(origins.distinct().select("origin", F.col("origin").alias("station"), F.lit(None).cast("string").alias("parent")),
                       "level-0")]
    while True:
        # a link leads to a station of the level before, of the same level or of the next one
        near = levels[-1].select("origin", "station")
        if len(levels) > 1:
            near = near.unionByName(levels[-2].select("origin", "station"))
        reached = levels[-1].select("origin", F.col("station").alias("a")).join(links, "a") \
            .groupBy("origin", F.col("b").alias("station")).agg(F.min("a").alias("parent"))
        level = _written(reached.join(near, ["origin", "station"], "left_anti"), f"level-{len(levels)}")
        if level.isEmpty():
            return levels
        levels.append(level)


def link_loads(od: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(a, b, flow): trips over each directed link. ``od``: (station_in,
    station_out, flow); pairs without a path, and journeys that end where they
    begin, use no link."""
    trips = _written(od.groupBy(F.col("station_in").alias("origin"), F.col("station_out").alias("station"))
                     .agg(F.sum("flow").alias("own")), "od")
    below, loads = None, []
    for level in reversed(levels[1:]):
        rows = level.join(trips, ["origin", "station"], "left")
        if below is not None:
            rows = rows.join(below, ["origin", "station"], "left")
        load = F.coalesce("own", F.lit(0)) + (F.lit(0) if below is None else F.coalesce("passing", F.lit(0)))
        rows = _written(rows.select("origin", "station", "parent", load.cast("long").alias("load")).where("load <> 0"), "loads")
        loads.append(rows.select(F.col("parent").alias("a"), F.col("station").alias("b"), "load"))
        below = rows.groupBy("origin", F.col("parent").alias("station")).agg(F.sum("load").alias("passing"))
    if not loads:
        return od.sparkSession.createDataFrame([], "a string, b string, flow long")
    every = loads[0]
    for part in loads[1:]:
        every = every.unionByName(part)
    return every.groupBy("a", "b").agg(F.sum("load").cast("long").alias("flow"))


def network_flows(od: DataFrame, stations: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """Section flows of all journeys of an OD matrix, also those that change
    lines -> (line, section_id, source, target, direction, flow); sections
    without a journey have 0."""
    origins = od.where("station_in IS NOT NULL").select(F.col("station_in").alias("origin"))
    loads = _written(link_loads(od, shortest_path_levels(station_links(stations, transfers), origins)), "link-loads")
    ways = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.col("source").alias("a"), F.col("target").alias("b")),
                             F.struct(F.lit("down").alias("direction"), F.col("target").alias("a"), F.col("source").alias("b"))))
    return (sequence_sections(stations).select("line", "section_id", "source", "target", ways.alias("w")).select("*", "w.*")
            .join(loads, ["a", "b"], "left")
            .select("line", "section_id", "source", "target", "direction", F.coalesce("flow", F.lit(0)).cast("long").alias("flow")))
