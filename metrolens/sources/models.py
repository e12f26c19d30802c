"""Forecast parameters as tables.

* basis      (model, entity, factor, weight)  - the low-rank bases P
* ar_coef    (model, factor, lag, weight)     - per-factor AR weights
* total_coef (feature, weight)                - raw-feature weights of Q9's linear model
* a fitted Spark ML ``PipelineModel`` for Q9 (e.g. scaler + GBT), saved/loaded
  with Spark ML's own persistence.

``basis_from_npy`` imports an existing entities x k ``.npy`` basis whose rows
follow the sorted station names, which is how such matrices were laid out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens import schemas
from metrolens.operators.series import Trees
from metrolens.session import scratch_path


def read_basis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BASIS).parquet(path)


def read_ar_coef(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AR_COEF).parquet(path)


def read_total_coef(spark: SparkSession, path: str) -> dict[str, float]:
    """Raw-feature weights (a handful of rows) as the mapping Q9 takes."""
    return {r["feature"]: float(r["weight"]) for r in
            spark.read.schema(schemas.TOTAL_COEF).parquet(path).collect()}


def write_params(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def trees_of(model: PipelineModel) -> Trees:
    """The tree ensemble of a fitted scaler + tree pipeline (one decision tree,
    a forest or boosted trees) as flat arrays for ``series.recursive_forecast_trees``:
    read from the model's saved form, whose size is that of the model."""
    spark = SparkSession.getActiveSession()
    scaler, fitted = model.stages[1], model.stages[-1]
    path = scratch_path(spark, "trees")
    fitted.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" not in saved.columns:                              # a single tree
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    nodes = [r for r in saved.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
                                     "nodeData.split").orderBy("treeID", "id").collect()]
    place = {(r["treeID"], r["id"]): i for i, r in enumerate(nodes)}
    inner = lambda r: r["leftChild"] >= 0
    if any(inner(r) and r["split"]["numCategories"] >= 0 for r in nodes):
        raise ValueError("splits by category are not supported")
    child = lambda r, side: place[r["treeID"], r[side]] if inner(r) else -1
    left, right = [child(r, "leftChild") for r in nodes], [child(r, "rightChild") for r in nodes]
    depth = [0] * len(nodes)
    for i in reversed(range(len(nodes))):                          # children follow their parent
        depth[i] = 1 + max(depth[left[i]], depth[right[i]]) if left[i] >= 0 else 0
    roots = [place[t, 0] for t in sorted({r["treeID"] for r in nodes})]
    weights = list(getattr(fitted, "treeWeights", [1.0])) or [1.0]
    if isinstance(fitted, RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    std = scaler.std.toArray()
    return Trees(feature=[r["split"]["featureIndex"] if inner(r) else -1 for r in nodes],
                 threshold=[r["split"]["leftCategoriesOrThreshold"][0] if inner(r) else 0.0 for r in nodes],
                 left=left, right=right, value=[r["prediction"] for r in nodes], roots=roots, weights=weights,
                 depth=max(depth[r] for r in roots), scale=[1 / s if s else 0.0 for s in std])


def basis_from_npy(spark: SparkSession, npy_path, model: str, entities: Sequence[str]) -> DataFrame:
    """Import an entities x k basis saved with numpy (a path or an open file); row i belongs to the
    i-th name of ``sorted(entities)``. Zero loadings are kept, so that every
    entity stays in the basis. The matrix goes to Spark as Arrow columns."""
    import numpy as np
    import pyarrow as pa

    p = np.load(npy_path)
    names = sorted(entities)
    if p.ndim != 2 or p.shape[0] != len(names):
        raise ValueError(f"basis has shape {p.shape}, expected ({len(names)}, k)")
    n, k = p.shape
    table = pa.table({"model": pa.array([model] * (n * k), pa.string()), "entity": np.repeat(np.array(names, object), k),
                      "factor": np.tile(np.arange(k, dtype=np.int32), n), "weight": p.astype(float).ravel()})
    return spark.createDataFrame(table, schemas.BASIS)
