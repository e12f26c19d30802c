"""Explicit schemas for every input and intermediate table."""

from pyspark.sql import types as T

TRIPS = T.StructType([
    T.StructField("time_in", T.TimestampNTZType()),
    T.StructField("time_out", T.TimestampNTZType()),
    T.StructField("station_in", T.StringType()),
    T.StructField("station_out", T.StringType()),
    T.StructField("line_in", T.StringType()),
    T.StructField("line_out", T.StringType()),
])

USERS = T.StructType([
    T.StructField("sex", T.IntegerType()),          # 0 male, 1 female
    T.StructField("birth_year", T.IntegerType()),
])

WORKDAYS = T.StructType([
    T.StructField("time", T.DateType()),
    T.StructField("workday", T.IntegerType()),      # 1 = workday
])

STATIONS = T.StructType([
    T.StructField("id", T.IntegerType()),           # not unique
    T.StructField("station_name", T.StringType()),  # the key
    T.StructField("line_name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("sequence", T.IntegerType()),
])

_OD = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
])

SECTION_OD_JSON = T.MapType(
    T.StringType(),
    T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("related_OD", T.ArrayType(_OD)),
    ])),
)

SECTION_BRIDGE = T.StructType([
    T.StructField("line", T.StringType()),
    T.StructField("section_id", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("o_station", T.StringType()),
    T.StructField("d_station", T.StringType()),
])

# Long panel fed to the low-rank forecaster.
MATRIX = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("flow", T.DoubleType()),
])

BASIS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("factor", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
])

AR_COEF = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("factor", T.IntegerType()),
    T.StructField("lag", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
])

# The same across factors: the weight of factor ``source`` ``lag`` days before.
CROSS_AR_COEF = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("factor", T.IntegerType()),
    T.StructField("lag", T.IntegerType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
])

# Hourly counts of one side ('in': entries, 'out': exits), see streaming/rollup.py.
ROLLUP = T.StructType([
    T.StructField("side", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("station", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("peer_station", T.StringType()),
    T.StructField("peer_line", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("month", T.DateType()),
])

# Coefficients of the one-step total-flow regression, on raw features.
TOTAL_COEF = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

# Input tables of the synthetic test data (read with explicit schemas).
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
