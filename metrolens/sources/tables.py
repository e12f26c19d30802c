"""Readers for the application tables (A1-A4), all with explicit schemas.

Column names are English; the original deployment stored the same fields
under other names, so each reader takes an optional rename map applied
before the schema cast (``{"our_name": "stored_name"}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolens import schemas


def _conform(df: DataFrame, schema: T.StructType, rename: dict[str, str] | None) -> DataFrame:
    rename = rename or {}
    return df.select(*[F.col(rename.get(f.name, f.name)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


ENTRY_DAY = T.StructField("entry_day", T.DateType())


def read_trips(spark: SparkSession, path: str, rename: dict[str, str] | None = None,
               by_day: bool = False) -> DataFrame:
    """Trip fact table (A1): one row per journey. ``by_day``: the table was
    written by :func:`write_trips`; queries by entry day then read only the
    partitions of their range, and queries by exit day too when ``Inputs`` is
    given the span table (:func:`read_trip_spans`)."""
    schema = T.StructType([*schemas.TRIPS.fields, ENTRY_DAY]) if by_day else schemas.TRIPS
    if rename:
        return _conform(spark.read.parquet(path), schema, rename)
    return spark.read.schema(schema).parquet(path)


def write_trips(trips: DataFrame, path: str, append: bool = False) -> None:
    """Trips partitioned by entry day, and beside them the span table: per
    entry day the first and last exit day of its trips. Rows are rebalanced by
    day, so a large day is split over several tasks and files, small days
    share a task. ``append`` adds trips to the table."""
    spark, mode = trips.sparkSession, "append" if append else "errorifexists"
    days = trips.withColumn("entry_day", F.to_date("time_in"))
    spans = days.groupBy("entry_day").agg(F.min(F.to_date("time_out")).alias("first_exit"), F.max(F.to_date("time_out")).alias("last_exit"))
    days.hint("rebalance", "entry_day").write.mode(mode).partitionBy("entry_day").parquet(path)
    spans.select(*SPANS.names).coalesce(1).write.mode(mode).parquet(_spans_path(path))


SPANS = T.StructType([ENTRY_DAY, T.StructField("first_exit", T.DateType()), T.StructField("last_exit", T.DateType())])


def _spans_path(path: str) -> str:
    return path.rstrip("/") + "-spans"


def read_trip_spans(spark: SparkSession, path: str) -> DataFrame:
    """(entry_day, first_exit, last_exit) of a table written by :func:`write_trips`."""
    return spark.read.schema(SPANS).parquet(_spans_path(path)).groupBy("entry_day") \
        .agg(F.min("first_exit").alias("first_exit"), F.max("last_exit").alias("last_exit"))


def read_users(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """User dimension (A3)."""
    if rename:
        return _conform(spark.read.parquet(path), schemas.USERS, rename)
    return spark.read.schema(schemas.USERS).parquet(path)


def read_workdays(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Calendar dimension (A2): ``time`` date, ``workday`` 1/0."""
    if rename:
        return _conform(spark.read.parquet(path), schemas.WORKDAYS, rename)
    return spark.read.schema(schemas.WORKDAYS).parquet(path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension (A4) from the CSV layout
    ``id,station_name,line_name,district,sequence`` with a header row."""
    return (spark.read.schema(schemas.STATIONS)
            .option("header", "true").option("mode", "FAILFAST").csv(path))
