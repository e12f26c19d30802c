"""Embedding whitening by QDWH spectral divide and conquer (operator 12).

Entries are taken as integers x = floor(1024 c) + 100000. One pass sums them
exactly, a second sums the products of the centred vectors; both are added up
by Spark and leave d and d (d + 1) / 2 numbers for the driver. There the
covariance is split: the unitary polar factor U of V - s I, found by the
QR- and Cholesky-based dynamically weighted Halley iteration, gives the
projector (I + U) / 2 onto the components with eigenvalues above s; orthonormal
bases of its range and its complement reduce V to two smaller matrices, which
are split in turn. Subspaces that hold none of the wanted components are left
whole. The components (k x d numbers) travel to the tasks that whiten.

Rows whose vector is null, or holds a null or non-finite entry, or has another
length than most, are left out; other columns are passed by or ignored. Ties:
equal eigenvalues get any orthonormal basis of their space. A component whose
eigenvalue is zero to working precision cannot be whitened and is left out.
Repeated rows count and are returned each; an empty table gives no rows. A null
id stays null. Entries beyond 2^41, and vectors longer than ``MAX_DIM``, are errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import stored
from metrolens.llm.vectors import matrices, usable

SCALE, OFFSET = 1024, 100_000       # fixed values of the integer form
COMPONENTS = 8
MAX_DIM = 2048                      # the covariance, MAX_DIM^2 numbers, is split on the driver
_EPS = np.finfo(float).eps


# --- spectral divide and conquer


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix (QDWH)."""
    n = len(a)
    x = a / np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())        # largest singular value at most 1
    r = np.abs(np.diag(np.linalg.qr(x, mode="r")))
    if r.min() > _EPS:
        low = max(1 / np.linalg.norm(np.linalg.inv(x)), _EPS)               # at most the smallest singular value
    else:
        low = _EPS
    for _ in range(30):
        if abs(1 - low) < 10 * _EPS:
            break
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(np.eye(n) + wc * (x.T @ x), x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
    return x


def _split(a: np.ndarray, floor: float, rng: np.random.Generator):
    """Orthonormal bases (upper, lower) of two invariant subspaces of ``a``, the
    eigenvalues of the first above those of the second; None if ``a`` is a
    multiple of the identity up to ``floor``."""
    n = len(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= floor:
        return None
    best = None
    for attempt in range(40):
        shift = np.median(np.diag(a)) if not attempt else centre + spread * rng.normal() / (np.sqrt(n) * (1 + attempt % 5))
        try:
            projector = (np.eye(n) + polar_factor(a - shift * np.eye(n))) / 2
        except np.linalg.LinAlgError:
            continue                                        # a singular step: another shift
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        upper, _ = np.linalg.qr(projector @ rng.normal(size=(n, k)))
        upper, _ = np.linalg.qr(projector @ upper)
        rest = np.eye(n) - projector
        lower, _ = np.linalg.qr(rest @ rng.normal(size=(n, n - k)))
        lower, _ = np.linalg.qr(rest @ lower)
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
        left = np.linalg.norm(lower.T @ a @ upper)          # what the split loses
        if best is None or left < best[0]:
            best = (left, upper, lower)
        if left <= floor:
            break                                           # else the shift met an eigenvalue
    return best[1:] if best else None


def components(v: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their
    unit eigenvectors as columns."""
    scale = np.linalg.norm(v)
    if not len(v) or not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    rng, found = np.random.default_rng(seed), []
    spaces = [np.eye(len(v))]                               # bases, the upper half of a split on top
    while spaces and len(found) < k:
        basis = spaces.pop()
        if basis.shape[1] > 1:
            own = basis.T @ v @ basis
            parts = _split((own + own.T) / 2, 4 * _EPS * scale, rng)
            if parts:
                spaces += [basis @ parts[1], basis @ parts[0]]
                continue
        found += list(basis.T)
    vectors = np.array(found[:k])
    for i in range(len(vectors)):                           # bases of bases: orthonormal to the last bit
        vectors[i] -= vectors[:i].T @ (vectors[:i] @ vectors[i])
        vectors[i] /= np.linalg.norm(vectors[i])
    values = np.einsum("id,de,ie->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order].T


# --- passes over the table


def integers(matrix: np.ndarray) -> np.ndarray:
    """x = floor(1024 c) + 100000 of every entry."""
    if len(matrix) and np.abs(matrix).max() > 2.0 ** 41:
        raise ValueError("embedding entries beyond 2^41 are not supported")
    return np.floor(SCALE * matrix).astype(np.int64) + OFFSET


def _sums(column: str, d: int):
    def run(batches):
        total, n = np.zeros(d, object), 0
        for batch in batches:
            for _, m in matrices(batch, column, d):
                total = total + integers(m).sum(0).astype(object)
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total]),
                                              pa.array([n] * d, pa.int64())], names=["i", "total", "n"])
    return run


def _products(column: str, mean: np.ndarray):
    d = len(mean)
    i, j = np.triu_indices(d)

    def run(batches):
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            for _, m in matrices(batch, column, d):
                y = integers(m) - mean
                total += y.T @ y
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "v"])
    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 per row, exact."""
    reach = max(abs(n * int(b) - s) for b, s in zip(x.max(0), sums)) if len(x) else 0
    reach = max([reach] + [abs(n * int(b) - s) for b, s in zip(x.min(0), sums)]) if len(x) else 0
    kind = np.int64 if reach * reach * x.shape[1] < 2 ** 62 and n * int(np.abs(x).max(initial=0)) < 2 ** 62 else object
    far = x.astype(kind) * n - np.array(sums, dtype=kind)
    return (far * far).sum(1).tolist()


def _whiten(column: str, ident: str, n: int, sums: list[int], basis: np.ndarray):
    mean = np.array([s / n for s in sums])

    def run(batches):
        decimal = pa.decimal128(38, 0)
        for batch in batches:
            for start, m in matrices(batch, column, len(mean)):
                x = integers(m)
                w = (x - mean) @ basis
                offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ident).slice(start, len(w)), pa.array(_deviations(x, n, sums), decimal),
                     pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=[ident, "deviation", "whitened"])
    return run


def whitening(spark: SparkSession, rows: DataFrame, column: str = "embedding", ident: str = "vec_id",
              k: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """(whitened vectors, fit): a written table (ident, deviation decimal,
    whitened array of at most ``k`` doubles), and the fitted numbers: n, sums,
    eigenvalues, components (d x k), explained, identity_error."""
    rows, d = usable(rows.select(ident, column), column)
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries: at most {MAX_DIM} are supported")
    added = rows.mapInArrow(_sums(column, d), "i int, total string, n long").groupBy("i").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()     # d rows
    n, sums = (added[0]["n"], [int(r["s"]) for r in added]) if added else (0, [])
    v = np.zeros((d, d))
    if n:
        mean = np.array([s / n for s in sums])
        for r in rows.mapInArrow(_products(column, mean), "i int, j int, v double").groupBy("i", "j") \
                .agg(F.sum("v").alias("v")).collect():                                                    # d (d + 1) / 2 rows
            v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["v"] / n
    values, vectors = components(v, k)
    able = values > len(v) * _EPS * np.trace(v)
    values, vectors = values[able], vectors[:, able]
    schema = f"{ident} {rows.schema[ident].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    if not len(values):
        made = spark.createDataFrame([], schema)
        return made, {"n": n, "sums": sums, "eigenvalues": values, "components": vectors, "explained": [], "identity_error": 0.0}
    made = stored(spark, rows.mapInArrow(_whiten(column, ident, n, sums, vectors / np.sqrt(values)), schema), "whitened")
    at = lambda i: F.col("whitened")[i]
    centre = made.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(len(values))]).collect()[0]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    spread = made.agg(*[F.avg((at(i) - centre[i]) * (at(j) - centre[j])).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    error = max(abs(c - (i == j)) for c, (i, j) in zip(spread, pairs))
    return made, {"n": n, "sums": sums, "eigenvalues": values, "components": vectors,
                  "explained": (values / np.trace(v)).tolist(), "identity_error": float(error)}
