"""Views that turn the shared synthetic test tables into metrolens inputs.

The test data has no trip table, so two trip views are derived from it
(see FIXTURES.md):

* ``trips_ev`` - each event of a user is an entry and the user's next event
  is the exit; the number ``k`` in ``props`` is the station.
* ``trips_od`` - an order line is a journey from the customer's nation
  (entered on the order date) to the supplier's nation (left on the ship
  date); regions are lines.

Dimension views (stations, users, calendar) and the fixture model
parameters (basis, AR and regression coefficients) are derived here too.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolens import schemas

# Fixed values of the test views (FIXTURES.md section 2).
EV_LINES = 10                                 # line = k % 10, sequence = k div 10
HOLIDAYS = [dt.date(2024, 1, 1)]              # workday = 0
CALENDAR_GAPS = [dt.date(2024, 1, 15)]        # left out of the calendar
CALENDAR_HORIZON_DAYS = 31                    # calendar runs past the last trip day
USER_SEX_MOD = 2                              # sex = c_custkey % 2
USER_BIRTH_BASE, USER_BIRTH_MOD = 1915, 110   # birth_year = 1915 + c_custkey % 110
TRANSFER_POS = 5                              # where the lines of stations_ev meet
FIXTURE_MOD = 3                               # basis of entity i: weights 1 and i % 3 on factors 0 and 1
FIXTURE_RANK = 2
QUIET_STATION = (1000, "S_new", "L0", 100)    # a station of stations_ev without any trip: id, name, line, sequence
# Section bridge written as JSON: line -> sections with their related OD pairs,
# with cross-line pairs, a repeated pair and a section without pairs.
FIXTURE_BRIDGE = {
    "L3": [
        {"source": "S03", "target": "S13", "related_OD": [("S03", "S13"), ("S03", "S23"), ("S03", "S55"), ("S03", "S55")]},
        {"source": "S13", "target": "S23", "related_OD": [("S03", "S23"), ("S13", "S23"), ("S42", "S93"), ("S13", "S07")]},
        {"source": "S23", "target": "S33", "related_OD": []},
        {"source": "S33", "target": "S43", "related_OD": [("S33", "S43"), ("S33", "S93"), ("S91", "S43"), ("S00", "S99")]},
    ],
    "L7": [
        {"source": "S07", "target": "S17", "related_OD": [("S07", "S17"), ("S07", "S97"), ("S13", "S07"), ("S10", "S20")]},
        {"source": "S17", "target": "S27", "related_OD": [("S17", "S27"), ("S17", "S33"), ("S55", "S56"), ("S60", "S70")]},
    ],
}
FIXTURE_AR = {1: 0.6, 7: 0.4}                 # factor AR weights by lag, 0 otherwise
FIXTURE_TOTAL = {"is_workday": 3.0, "lag_1": 1 / 3, "lag_7": 1 / 3, "lag_14": 1 / 3}
WINDOW_DAYS = 28


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.select("event_id", "user_id", "ts",
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


def _station(k: F.Column) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 2, "0"))


def _line(k: F.Column) -> F.Column:
    return F.concat(F.lit("L"), (k % EV_LINES).cast("string"))


def next_event_ranged(ev: DataFrame, key: str, ts: str, tie: str, payload: list[str],
                      partitions: int | None = None) -> DataFrame:
    """Exact successor per ``key`` that no key can concentrate in one task.

    ``repartitionByRange(key, ts, tie)`` samples the data and cuts it into
    contiguous ranges of about equal size, so a key holding a third of all
    rows spans many partitions. One pass over each sorted range attaches the
    following row and the range number; its result is written once, so both
    uses below see the same ranges whatever the planner reuses. The last row
    of a range takes the first row of the next non-empty range, found through
    a table with one row per range (bounded by the partition count). One
    shuffle of the rows, no hot task.
    """
    from metrolens.session import scratch_path

    spark = ev.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = {"key": key, "ts": ts, "tie": tie} | {c: c for c in payload}
    cur = F.struct(*[F.col(c).alias(f) for f, c in fields.items()])
    ranged = (ev.repartitionByRange(n, key, ts, tie).sortWithinPartitions(key, ts, tie)
              .withColumn("_range", F.spark_partition_id()))
    path = scratch_path(spark, "next-event")
    out = ranged.withColumn("_nxt", cur).withColumn("_first", F.lit(False)).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out])                # the last row has no next
    ranged.mapInArrow(_attach_next(fields), schema).write.parquet(path)
    legs = spark.read.schema(schema).parquet(path)
    heads = (legs.where("_first").select("_range", cur.alias("_head"))
             .withColumn("_next_head", F.lead("_head").over(Window.orderBy("_range")))
             .select("_range", "_next_head"))
    cand = F.coalesce("_nxt", "_next_head")
    return (legs.join(F.broadcast(heads), "_range", "left")
            .withColumn("_nxt", F.when(cand["key"] == F.col(key), cand))
            .drop("_next_head", "_range", "_first"))


def _attach_next(fields: dict[str, str]):
    """mapInArrow step over a sorted partition: ``_nxt`` becomes a struct of the
    next row's columns, ``fields`` by name (null in the last row), ``_first``
    marks the first row."""
    import pyarrow as pa

    def struct(rows):
        return pa.StructArray.from_arrays([rows.column(c) for c in fields.values()], names=list(fields))

    def paired(rows, nxt, first: bool):
        marks = pa.array([first] + [False] * (rows.num_rows - 1), pa.bool_())
        return pa.RecordBatch.from_arrays([*rows.columns, nxt, marks], names=[*rows.schema.names, "_nxt", "_first"])

    def run(batches):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            out, nxt = rows.slice(0, rows.num_rows - 1), rows.slice(1)
            held = rows.slice(rows.num_rows - 1)
            if out.num_rows:
                yield paired(out, struct(nxt), first)
                first = False
        if held is not None:
            yield paired(held, pa.nulls(1, struct(held).type), first)
    return run


def trips_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from consecutive events of a user (30 days, real hours)."""
    ev = events_k(spark, sf_dir)
    legs = next_event_ranged(ev, "user_id", "ts", "event_id", ["k"]).where(F.col("_nxt").isNotNull())
    return legs.select(
        F.col("event_id").alias("trip_id"), "user_id",
        F.col("ts").alias("time_in"), F.col("_nxt.ts").alias("time_out"),
        _station(F.col("k")).alias("station_in"), _line(F.col("k")).alias("line_in"),
        _station(F.col("_nxt.k")).alias("station_out"), _line(F.col("_nxt.k")).alias("line_out"),
    )


_STORED: dict[tuple, tuple] = {}


def stored_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived test view written once per session as a parquet table in
    the shared checkpoint folder, then read like the stored tables of a
    deployment (filters and columns pushed to the scan).

    Trip views are sorted by entry time within each file, so the parquet
    min/max statistics let date-range filters skip row groups.
    """
    from metrolens.session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _STORED:
        derive = {"trips_ev": trips_ev, "trips_od": trips_od, "stations_ev": stations_ev,
                  "stations_od": stations_od, "workdays_v": workdays_v, "workdays_od": workdays_od}[name]
        df = derive(spark, sf_dir)
        if name.startswith("trips"):
            df = df.sortWithinPartitions("time_in")
        path = scratch_path(spark, name)
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)      # known schema: no footer inference


def stored_trips(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return stored_view(spark, sf_dir, f"trips_{kind}")


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey) \
                 .select("n_nationkey", "n_name", "r_name")


def trips_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from order lines: customer nation -> supplier nation.

    Rows are joined as keys and get their names last. They are rebalanced for
    the sort that follows (``stored_view``), so that what a task holds is bounded
    by the advisory partition size and not by its share of the order lines.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("_in"))
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("_out"))
    placed = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "_in")
    keyed = (li.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("time_in"),
                     F.col("l_shipdate").alias("time_out"), "_in", "_out"))
    nr = _nation_region(spark, sf_dir)

    def names(side: str) -> DataFrame:
        return F.broadcast(nr.select(F.col("n_nationkey").alias(f"_{side}"), F.col("n_name").alias(f"station_{side}"),
                                     F.col("r_name").alias(f"line_{side}")))
    return (keyed.join(names("in"), "_in").join(names("out"), "_out")
            .select("user_id", "time_in", "time_out", "station_in", "line_in", "station_out", "line_out")
            .hint("rebalance", "user_id", "time_in", "time_out"))


def stations_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension of ``trips_ev``: every station number seen in
    events, and one station without any trip."""
    ks = events_k(spark, sf_dir).select("k").where(F.col("k").isNotNull()).distinct()
    seen = ks.select(F.col("k").alias("id"), _station(F.col("k")).alias("station_name"),
                     _line(F.col("k")).alias("line_name"), F.lit(None).cast("string").alias("district"),
                     (F.col("k") / EV_LINES).cast("int").alias("sequence"))
    quiet = [F.lit(v).alias(c) for v, c in zip(QUIET_STATION, ("id", "station_name", "line_name", "sequence"))]
    return seen.unionByName(spark.range(1).select(*quiet, F.lit(None).cast("string").alias("district")))


def stations_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension of ``trips_od``: nations, numbered within their region."""
    nr = _nation_region(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))
    return nr.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("station_name"),
                     F.col("r_name").alias("line_name"), F.col("r_name").alias("district"),
                     seq.alias("sequence"))


def users_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _table(spark, sf_dir, "customer").select("c_custkey")
    return cust.select((F.col("c_custkey") % USER_SEX_MOD).cast("int").alias("sex"),
                       (F.lit(USER_BIRTH_BASE) + F.col("c_custkey") % USER_BIRTH_MOD)
                       .cast("int").alias("birth_year"))


def workdays_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar over the event history plus a forecast horizon.

    Saturday/Sunday and the holidays are 0, other days 1; the gap days are
    left out so that a day missing from the calendar is exercised.
    """
    return _calendar(events_k(spark, sf_dir), "ts")


def workdays_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calendar over the order history."""
    return _calendar(_table(spark, sf_dir, "orders"), "o_orderdate")


def _calendar(rows: DataFrame, ts: str) -> DataFrame:
    bounds = rows.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))
    days = bounds.select(F.explode(F.sequence(
        "lo", F.date_add("hi", CALENDAR_HORIZON_DAYS))).alias("time"))
    holiday = F.col("time").isin([F.lit(d) for d in HOLIDAYS])
    weekend = F.weekday("time") >= 5
    return (days.where(~F.col("time").isin([F.lit(d) for d in CALENDAR_GAPS]))
            .select("time", F.when(holiday | weekend, 0).otherwise(1).cast("int").alias("workday")))


def transfers_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of ``stations_ev``: the station at ``TRANSFER_POS`` of line L0
    is linked with the one at the same place of every other line."""
    at = stored_view(spark, sf_dir, "stations_ev").where(F.col("sequence") == TRANSFER_POS)
    hub = at.where("line_name = 'L0'").select(F.col("station_name").alias("a"), "sequence")
    return hub.join(at.where("line_name <> 'L0'").select(F.col("station_name").alias("b"), "sequence"), "sequence").select("a", "b")


def fixture_basis(entities: DataFrame) -> DataFrame:
    """Basis with two columns that are not orthogonal: entity i (by name
    within its model) has weight 1 on factor 0 and i % 3 on factor 1."""
    i = F.row_number().over(Window.partitionBy("model").orderBy("entity")) - 1
    weights = F.array(F.lit(1.0), (i % FIXTURE_MOD).cast("double"))
    return (entities.select("model", "entity", weights.alias("w"))
            .select("model", "entity", F.posexplode("w").alias("factor", "weight")))


def section_json(spark: SparkSession) -> str:
    """The fixture bridge written as a JSON file; its folder."""
    import json

    from metrolens.session import scratch_path

    pair = lambda od: {"source": od[0], "target": od[1]}
    lines = {line: [s | {"related_OD": [pair(od) for od in s["related_OD"]]} for s in secs]
             for line, secs in FIXTURE_BRIDGE.items()}
    path = scratch_path(spark, "section-json")
    spark.createDataFrame([(json.dumps(lines),)], "value string").coalesce(1).write.text(path)
    return path


def fixture_ar_coef(spark: SparkSession, models: list[str], rank: int = FIXTURE_RANK,
                    window: int = WINDOW_DAYS) -> DataFrame:
    """Per-factor AR weights for every model, lags 1..window."""
    weight = F.lit(0.0)
    for lag, w in FIXTURE_AR.items():
        weight = F.when(F.col("lag") == lag, F.lit(w)).otherwise(weight)
    base = spark.createDataFrame([(m,) for m in models], "model string")
    return (base.select("model", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("factor"))
            .select("model", "factor", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("lag"))
            .select("model", F.col("factor").cast("int"), F.col("lag").cast("int"),
                    weight.cast("double").alias("weight")))
