"""Vector code compression with value dictionaries (operator 13).

Entries become integers floor(256 x), vectors are cut into equal parts, and
each part of a vector is replaced by the index of the nearest entry of the
part's codebook. Distances come from dictionaries: of each dimension the
distinct integers among the vectors at hand are numbered, the squared
difference of each of them to each codebook entry is tabulated once, and a
part's distance to all entries is a gather of table rows by number, added over
the part's dimensions. Codebooks start from the vectors with the smallest ids
and move to the (floored) means of their parts for ``ROUNDS`` rounds: tasks add
up sums and counts per entry, Spark adds the tasks, and the codebooks (parts x
entries x width numbers) travel back to the tasks.

Rows whose vector is null, or holds a null or non-finite component, or has
another length than most, are left out. Ties go to the lower entry; equal ids
start in order of their vectors, null ids last. Repeated rows count and are
coded each; with fewer rows than entries the codebook is as long as there are
rows; an empty table gives no rows. A length that the parts do not divide is an
error. Only the id, the vector and the label are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import stored
from metrolens.llm.vectors import matrices, usable

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
_SAFE = 2.0 ** 26        # integers whose squares can be added in 64 bits, up to 512 to a part


def integers(matrix: np.ndarray) -> np.ndarray:
    """floor(256 x) of every entry; exact Python integers where 64 bits do not do."""
    if not len(matrix) or np.abs(matrix).max() * SCALE < _SAFE:
        return np.floor(matrix * SCALE).astype(np.int64)

    def whole(x: float) -> int:
        return int(np.floor(x * SCALE)) if abs(x) < 1e300 else int(x) * SCALE
    return np.array([[whole(float(x)) for x in row] for row in matrix], dtype=object)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entries, squared distances), both (rows, parts), of integer
    vectors against ``books`` (parts, entries, width)."""
    parts, entries, width = books.shape
    kind = object if x.dtype == object or books.dtype == object else np.int64
    nearest = np.zeros((len(x), parts), np.int64)
    error = np.zeros((len(x), parts), kind)
    for p in range(parts):
        distance = np.zeros((len(x), entries), kind)
        for j in range(width):
            values, number = np.unique(x[:, p * width + j], return_inverse=True)
            table = (values.astype(kind)[:, None] - books[p, :, j].astype(kind)[None, :]) ** 2
            distance += table[number.reshape(-1)]
        nearest[:, p] = distance.argmin(1)
        error[:, p] = distance[np.arange(len(x)), nearest[:, p]]
    return nearest, error


def _part_sums(column: str, books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, m in matrices(batch, column, parts * width):
                x = integers(m)
                nearest, _ = assign(x, books)
                for p in range(parts):
                    order = np.argsort(nearest[:, p], kind="stable")
                    used, first = np.unique(nearest[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p * width:(p + 1) * width], first).astype(object)
                    counts[p, used] += np.diff(np.append(first, len(x)))
        p, e = np.nonzero(counts)
        if len(p):
            cells = np.repeat(np.arange(len(p)), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[cells], pa.int32()), pa.array(e[cells], pa.int32()),
                 pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
                 pa.array([str(s) for s in sums[p, e].ravel()]), pa.array(counts[p, e][cells], pa.int64())],
                names=["part", "entry", "at", "total", "n"])
    return run


def fit_codebooks(rows: DataFrame, d: int, column: str, ident: str, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of usable vectors."""
    if d % parts or not d:
        raise ValueError(f"vectors of {d} entries have no {parts} equal parts")
    start = rows.orderBy(F.asc_nulls_last(ident), column).limit(entries).collect()         # ``entries`` rows
    books = integers(np.array([r[column] for r in start], float)).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = rows.mapInArrow(_part_sums(column, books), "part int, entry int, at int, total string, n long") \
            .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for r in moved.collect():                                                          # parts x entries x width rows
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return books


def _codes(column: str, books: np.ndarray, keep: list[str]):
    def run(batches):
        for batch in batches:
            for start, m in matrices(batch, column, books.shape[0] * books.shape[2]):
                nearest, error = assign(integers(m), books)
                code = [row.tobytes().hex() for row in nearest.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, len(m)) for c in keep] + [pa.array(code), pa.array(error.sum(1).tolist(), pa.int64())],
                    names=[*keep, "code", "error"])
    return run


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def vector_codes(spark: SparkSession, rows: DataFrame, column: str = "embedding", ident: str = "vec_id",
                 label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): a written table (ident, label, code, error, label_error)
    and the final codebooks (parts, entries, width)."""
    rows, d = usable(rows.select(ident, label, column), column)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (ident, label))
    schema = f"{kept}, code string, error long"
    if not d:
        return spark.createDataFrame([], f"{schema}, label_error long"), np.zeros((PARTS, 0, 0), np.int64)
    books = fit_codebooks(rows, d, column, ident)
    coded = stored(spark, rows.mapInArrow(_codes(column, books, [ident, label]), schema), "codes")
    # labels are summed where their rows are, then written, so that the join below can split a hot one
    totals = stored(spark, coded.groupBy(label).agg(F.sum("error").alias("label_error")), "label-errors") \
        .withColumnRenamed(label, "_label")
    joined = coded.join(totals, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    return joined, books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``vector``: the codebook entries its code names, over 256."""
    table = F.lit([[(entry / SCALE).tolist() for entry in part] for part in books])
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[table[p][number(p)] for p in range(len(books))])))
