"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.session import scratch_path

# Arrow batches are cut into slices of at most this many text bytes, so that a
# worker's arrays stay small however long the texts of one batch are: they take
# 20 to 40 bytes a byte of text, and freed arrays of this size go back to the
# system, which larger ones need not.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` below ``spark.checkpoint.dir``, read it back."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrowed(df: DataFrame, wanted: DataFrame, column: str, most: int = 4096) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is not in ``wanted`` (a
    written table of one column, same name): a bit per hashed value, at most
    ``most`` bitmaps of 4 KB, is broadcast. Rows that pass are a superset, so an
    exact join follows; it then shuffles only these instead of the whole table."""
    count = wanted.count()
    bits = 32768 * max(1, min(most, count * 16 // 32768))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = wanted.select((place / 32768).cast("int").alias("_map"), (place % 32768).alias("_bit")) \
        .groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = df.withColumn("_map", (place / 32768).cast("int")).withColumn("_bit", (place % 32768).cast("int"))
    hit = F.expr("(cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) as int) >> (_bit % 8)) & 1 = 1")
    return placed.join(F.broadcast(maps), "_map").where(hit).select(*df.columns)


def map_sorted_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(batch, bounds)`` over the groups of ``keys``: rows are brought
    together by key and sorted, and ``fn`` gets many whole groups at a time
    (group i is rows bounds[i] to bounds[i + 1]), so that small groups cost
    little. It returns a record batch. A group's rows must fit a task."""

    def run(batches):
        held = None

        def whole(table, last):
            batch = table.combine_chunks().to_batches()[0]
            changed = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                changed |= column[1:] != column[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [batch.num_rows]])
            return batch, cuts if last else cuts[:-1]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            rows, bounds = whole(table, last=False)
            if len(bounds) > 1:
                yield fn(rows.slice(0, int(bounds[-1])), bounds)
            held = pa.Table.from_batches([rows.slice(int(bounds[-1]))])
        if held is not None:
            yield fn(*whole(held, last=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def binary_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values are equally long."""
    if not len(column):
        return np.zeros((0, width or 1), np.uint8)
    start, stop = column.offset, column.offset + len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[start:stop + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(len(column), -1)


def binary_column(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a contiguous array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def id_bucket(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null ids: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``SLICE_BYTES`` of ``column``
    (one longer text makes a slice of its own)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if size and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str,
              keep: tuple[str, ...] = (), sliced_by: str = "text") -> DataFrame:
    """``mapInArrow`` over slices: ``fn`` turns a slice into a dict of columns
    (arrays or lists); the columns named in ``keep`` are passed through. When
    output rows are not the slice's rows one by one, ``fn`` adds ``take``: the
    row of the slice that each output row belongs to. A column made by ``fn``
    replaces a kept one of the same name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    types = {f.name: f.dataType for f in parsed.fields}
    keep = tuple(k for k in keep if k not in types)
    out = StructType([f for f in df.schema.fields if f.name in keep] + parsed.fields)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        for part in slices(batches, sliced_by):
            made = fn(part)
            names = [k for k in part.schema.names if k in keep]
            arrays = [part.column(k) for k in names]
            if "take" in made:
                at = pa.array(made["take"], pa.int64())
                arrays = [a.take(at) for a in arrays]
            for name in types:
                value = made[name]
                if not isinstance(value, pa.Array):
                    value = pa.array(value, type=arrow.field(name).type)
                arrays.append(value)
                names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, out)
