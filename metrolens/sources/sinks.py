"""Result sinks (A8, A10): nested record shape and file output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_nested(df: DataFrame, keys: Sequence[str], field: str = "items",
              order_by: Sequence[str] | None = None) -> DataFrame:
    """Group a long result into one row per key with an array of structs,
    the shape of the original API's records (e.g. station -> [{time, flow}]).

    Use only on bounded results (query outputs): each key's list lives in
    one row.
    """
    rest = [c for c in df.columns if c not in keys]
    order = list(order_by or rest)
    items = F.struct(*[F.col(c) for c in order + [c for c in rest if c not in order]])
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(items)).alias(field))


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row (A10), e.g. for a key-value store or an HTTP layer."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json_records(df: DataFrame, schema, column: str = "json") -> DataFrame:
    """Inverse of ``to_json_records``: parse one JSON text per row with a fixed schema."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                 mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
