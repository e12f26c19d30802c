"""Tree ensembles as array literals inside the recursive fold."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from metrolens.operators import series
from metrolens.sources import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(float(rng.random() < 0.7), *[float(rng.randrange(60)) for _ in series.LAGS], float(rng.randrange(-20, 20))) for _ in range(400)]
    return spark.createDataFrame([(*x, x[1] * 0.5 + 9 * x[0] + (x[3] > 30) * 11 + x[-1] / 3) for x in data], [*series.FEATURES, "label"])


def fitted(rows, reg):
    return Pipeline(stages=[VectorAssembler(inputCols=list(series.FEATURES), outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True), reg]).fit(rows)


@pytest.mark.parametrize("reg", [
    lambda: DecisionTreeRegressor(featuresCol="features", maxDepth=5),
    lambda: RandomForestRegressor(featuresCol="features", numTrees=7, maxDepth=4, seed=1),
    lambda: GBTRegressor(featuresCol="features", maxIter=9, maxDepth=3, seed=1),
    lambda: DecisionTreeRegressor(featuresCol="features", maxDepth=0)],
    ids=["tree", "forest", "boosted", "leaf"])
def test_flat_trees_equal_transform(rows, reg):
    model = fitted(rows, reg())
    trees = models.trees_of(model)
    both = model.transform(rows).withColumn("flat", trees.predict([F.col(f) for f in series.FEATURES]))
    assert both.agg(F.max(F.abs(F.col("flat") - F.col("prediction")))).collect()[0][0] < 1e-9


def test_fold_equals_model_step_by_step(spark, rows):
    model = fitted(rows, GBTRegressor(featuresCol="features", maxIter=8, maxDepth=4, seed=1))
    start, rng = dt.date(2024, 3, 1), random.Random(9)
    flows = [(s, start - dt.timedelta(days=i), rng.randrange(60)) for s in ("a", "b", "c") for i in range(1, 30) if rng.random() < 0.9]
    panel = spark.createDataFrame(flows, "station string, day date, flow long")
    cal = spark.createDataFrame([(start + dt.timedelta(days=i), int(i % 7 < 5)) for i in range(4)], "time date, workday int")
    names = spark.createDataFrame([(s,) for s in "abcd"], "station string")
    fold = series.recursive_forecast_trees(panel, cal, ["station"], models.trees_of(model), start, 5, entities=names)
    loop = series.recursive_forecast_model(panel, cal, ["station"], model, start, 5, entities=names)
    got, want = sorted(map(tuple, fold.collect())), sorted(map(tuple, loop.collect()))
    assert got == want and len(got) == 20
    assert "Python" not in fold._jdf.queryExecution().executedPlan().toString()
