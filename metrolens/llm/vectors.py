"""Vectors of a table as number matrices, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096              # vectors that a task holds as one matrix


def usable(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose vector is not null, is not empty, holds finite numbers only
    and has the usual length (that of most rows, the longer one of two), and
    this length; 0 for a table without such a vector."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    lengths = kept.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()         # the most frequent length
    d = usual[0]["d"] if usual else 0
    return kept.where(F.size(column) == d), d


def matrices(batch: pa.RecordBatch, column: str, d: int):
    """(first row, float64 matrix) of each ``ROWS`` rows of a batch of usable vectors."""
    for start in range(0, batch.num_rows, ROWS):
        flat = batch.column(column).slice(start, ROWS).flatten()
        yield start, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
