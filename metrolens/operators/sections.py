"""Track-section flows (A5 bridge, C3/C4, D11).

Two ways to turn an OD matrix into section flows:

* ``bridge_flows`` - the reference's model: a bridge table lists, for each
  section, the OD pairs whose journeys use it (loaded from the
  ``{line: [{source, target, related_OD: [...]}]}`` JSON). Up flow sums
  OD[o, d] over the listed pairs, down flow sums OD[d, o]. One equi-join of
  the tagged bridge with the aggregated OD table.
* ``sequence_flows`` - when no bridge is given, sections join consecutive
  stations of a line and a same-line journey uses every section between its
  two stations. Instead of listing those pairs, each OD count adds +flow at
  its lower boundary and -flow at its upper one, and a running sum along the
  line gives every boundary's flow: work grows with the OD table, not with
  pairs x sections.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrolens import schemas
from metrolens.functions.dates import as_date


def read_section_bridge(spark: SparkSession, path: str) -> DataFrame:
    """Flatten the section <-> OD JSON into a bridge table (A5).

    Sections keep their position in the line's list (``section_id``, from
    0); a section without related pairs is kept with null OD columns.
    Duplicate related pairs are kept (each counts once more, as in the
    reference). Malformed JSON, and JSON that is not one such object, is an
    error. The file is a parameter of the size of the track network.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", schemas.SECTION_OD_JSON, {"mode": "FAILFAST"}).alias("m"))
    bad = F.raise_error(F.lit("the section file holds no object of lines"))
    parsed = parsed.select(F.when(F.col("m").isNull() | (F.size("m") == 0), bad.cast(schemas.SECTION_OD_JSON))
                           .otherwise(F.col("m")).alias("m"))
    lines = parsed.select(F.explode("m").alias("line", "sections"))
    secs = lines.select("line", F.posexplode("sections").alias("section_id", "s"))
    return (secs.select("line", F.col("section_id").cast("int"),
                        F.col("s.source").alias("source"), F.col("s.target").alias("target"),
                        F.explode_outer("s.related_OD").alias("od"))
            .select("line", "section_id", "source", "target",
                    F.col("od.source").alias("o_station"), F.col("od.target").alias("d_station")))


def bridge_flows(od: DataFrame, bridge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Section flows from a bridge table (C3; with ``keys=['day']`` C4).

    ``od`` has station_in, station_out, flow (+ keys). Returns line,
    section_id, source, target, direction, flow (+ keys) for every bridge
    section; sections without flow get 0 when ``keys`` is empty.
    """
    keys = keys or []
    up = bridge.select("line", "section_id", "source", "target", F.lit("up").alias("direction"),
                       F.col("o_station").alias("station_in"), F.col("d_station").alias("station_out"))
    down = bridge.select("line", "section_id", "source", "target", F.lit("down").alias("direction"),
                         F.col("d_station").alias("station_in"), F.col("o_station").alias("station_out"))
    tagged = up.unionByName(down)
    joined = tagged.join(od, ["station_in", "station_out"], "left")
    sec_keys = ["line", "section_id", "source", "target", "direction"]
    if not keys:
        return joined.groupBy(*sec_keys).agg(
            F.coalesce(F.sum("flow"), F.lit(0)).cast("long").alias("flow"))
    return (joined.where(F.col("flow").isNotNull())
            .groupBy(*sec_keys, *keys).agg(F.sum("flow").cast("long").alias("flow")))


# Derived per stations table once and shared: the same lazy sub-plan is
# reused by every query that needs it (no repeated analysis, and Spark reuses
# the identical exchanges when the plans meet).
_POSITIONS: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()
_SECTIONS: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def station_positions(stations: DataFrame) -> DataFrame:
    """(line, station, pos): 1-based dense rank of ``sequence`` within the line."""
    if stations not in _POSITIONS:
        _POSITIONS[stations] = _station_positions(stations)
    return _POSITIONS[stations]


def _station_positions(stations: DataFrame) -> DataFrame:
    st = stations.select(F.col("line_name").alias("line"), F.col("station_name").alias("station"),
                         "sequence").where(F.col("station").isNotNull() & F.col("sequence").isNotNull())
    pos = F.dense_rank().over(Window.partitionBy("line").orderBy("sequence"))
    return st.select("line", "station", pos.alias("pos"))


def sequence_sections(stations: DataFrame) -> DataFrame:
    """Sections between consecutive positions of each line.

    (line, section_id, source, target, b) where ``b`` is the boundary
    (position of ``source``). Two stations sharing a position give parallel
    sections that carry the same flow.
    """
    if stations not in _SECTIONS:
        _SECTIONS[stations] = _sequence_sections(stations)
    return _SECTIONS[stations]


def _sequence_sections(stations: DataFrame) -> DataFrame:
    pos = station_positions(stations)
    a, b = pos.alias("a"), pos.alias("b")
    pairs = a.join(b, (F.col("a.line") == F.col("b.line")) & (F.col("b.pos") == F.col("a.pos") + 1))
    sid = F.row_number().over(Window.partitionBy("a.line")
                              .orderBy("a.pos", "a.station", "b.station")) - 1
    return pairs.select(F.col("a.line").alias("line"), sid.cast("int").alias("section_id"),
                        F.col("a.station").alias("source"), F.col("b.station").alias("target"),
                        F.col("a.pos").alias("b"))


def sequence_flows(od: DataFrame, stations: DataFrame, day_range=None) -> DataFrame:
    """Section flows of same-line journeys by a running sum along each line.

    ``od`` has station_in, station_out, flow (+ ``day`` when ``day_range``
    = (lo, hi) is given). Every section gets a row (per day of the range),
    zero when no journey crosses it.
    Returns line, section_id, source, target, direction, flow (+ day).
    """
    keys = ["day"] if day_range else []
    # Station positions are dimension-sized; AQE broadcasts them from their
    # runtime size once the (small) window stage has run.
    pos = station_positions(stations)
    o = pos.select(F.col("station").alias("station_in"), F.col("line").alias("o_line"),
                   F.col("pos").alias("o_pos"))
    d = pos.select(F.col("station").alias("station_out"), F.col("line").alias("d_line"),
                   F.col("pos").alias("d_pos"))
    same = (od.join(o, "station_in").join(d, "station_out")
            .where((F.col("o_line") == F.col("d_line")) & (F.col("o_pos") != F.col("d_pos"))))
    direction = F.when(F.col("o_pos") < F.col("d_pos"), "up").otherwise("down")
    lo = F.least("o_pos", "d_pos")
    hi = F.greatest("o_pos", "d_pos")
    deltas = (same.select(F.col("o_line").alias("line"), direction.alias("direction"), *keys,
                          F.explode(F.array(F.struct(lo.alias("b"), F.col("flow").alias("delta")),
                                            F.struct(hi.alias("b"), (-F.col("flow")).alias("delta"))))
                          .alias("e"))
              .groupBy("line", "direction", *keys, F.col("e.b").alias("b"))
              .agg(F.sum("e.delta").alias("delta")))
    sections = sequence_sections(stations)
    bounds = sections.select("line", "b").distinct() \
        .select("line", "b", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"))
    if day_range:
        lo, hi = (F.lit(as_date(x)) for x in day_range)
        bounds = bounds.withColumn("day", F.explode(F.sequence(lo, hi)))
    grid = bounds.join(deltas, ["line", "direction", "b", *keys], "left")
    run = Window.partitionBy("line", "direction", *keys).orderBy("b") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flows = grid.select("line", "direction", "b", *keys,
                        F.sum(F.coalesce("delta", F.lit(0))).over(run).cast("long").alias("flow"))
    return (sections.join(flows, ["line", "b"])
            .select("line", "section_id", "source", "target", "direction", *keys, "flow"))
