"""Learning the forecast parameters with Spark ML (M1-M4, M6 training).

The reference shipped pre-trained artefacts and no training code. These
fits produce the parameter tables the forecast queries take:

* ``fit_total_model``  - StandardScaler + LinearRegression on the eight
  one-step features of the total series; ``total_coefficients`` turns the
  fitted pipeline into raw-feature weights for ``recursive_forecast``.
* ``fit_pooled_model`` - the same one-step regression over every station's
  series at once: one aggregation, one 8 x 8 solve.
* ``fit_basis``        - the principal axes of each model's day vectors
  (entities as dimensions): the basis P (entity, factor, weight).
* ``fit_factor_ar``    - an autoregression of each factor series on its last
  ``window`` values: the (factor, lag, weight) table used by
  ``low_rank_forecast``; ``fit_cross_factor_ar`` with weights across factors.

Training rows are built with DataFrame operations. What reaches the driver is
bounded by the model and the number of days: the weights of Q9's model, one row
of moments, or days x (rank + 10) numbers; loadings and factor weights are made
and stay in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolens import schemas
from metrolens.operators import counts, lowrank, series
from metrolens.plans.inputs import Inputs
from metrolens.session import scratch_path

MAX_WEIGHTS = 16_384      # weights per factor of the cross-factor form: bounds its one group per model


def total_training_rows(inp: Inputs, start, end) -> DataFrame:
    """(day, label, is_workday, lag features) of the total entry series."""
    daily = counts.daily_counts(inp.trips, "time_in", start, end) \
        .select(F.lit("total").alias("series"), F.col("time").alias("day"), "flow")
    dense = series.densify_span(daily, ["series"])
    return _with_calendar(series.lag_features(dense, ["series"]), inp.workdays)


def _with_calendar(feats: DataFrame, workdays: DataFrame | None, keys=()) -> DataFrame:
    """Training rows: label, workday flag (0 off the calendar) and lag features."""
    if workdays is not None:
        cal = workdays.groupBy(F.col("time").alias("day")) \
            .agg(F.max((F.col("workday") == 1).cast("double")).alias("is_workday"))
        feats = feats.join(cal, "day", "left")
    else:
        feats = feats.withColumn("is_workday", F.lit(None).cast("double"))
    cols = [F.col(c).cast("double").alias(c) for c in series.FEATURES if c != "is_workday"]
    return (feats.select(*keys, "day", F.col("flow").cast("double").alias("label"),
                         F.coalesce("is_workday", F.lit(0.0)).alias("is_workday"), *cols)
            .where(F.col("trend").isNotNull()))


def fit_total_model(inp: Inputs, start, end, regressor: str = "linear", reg_param: float = 0.0,
                    seed: int = 42) -> PipelineModel:
    """M1 + M2: scaler and a regressor on the reference's feature order.

    ``regressor``: "linear" (weights usable by the recursive fold, see
    ``total_coefficients``) or "gbt" (gradient-boosted trees, folded with
    ``series.recursive_forecast_trees``).
    """
    rows = total_training_rows(inp, start, end)
    if regressor == "linear":
        reg = LinearRegression(featuresCol="features", labelCol="label", regParam=reg_param)
    elif regressor == "gbt":
        reg = GBTRegressor(featuresCol="features", labelCol="label", maxDepth=4, maxIter=40, seed=seed)
    else:
        raise ValueError(f"unknown regressor {regressor!r}")
    return _pipeline(reg, rows)


def panel_training_rows(inp: Inputs, start, end, series_spec: dict | None = None) -> DataFrame:
    """(series, day, label, is_workday, lag features) of every station's daily
    entries (or of the one series that ``series_spec`` names)."""
    daily = counts.station_day_counts(inp.trips_touching(start, end), start, end, series_spec or {"station_in": ("in", None)})
    dense = series.densify_span(daily.select(F.col("entity").alias("series"), "day", "flow"), ["series"])
    return _with_calendar(series.lag_features(dense, ["series"]), inp.workdays, ["series"])


def pooled_regression(rows: DataFrame, features=series.FEATURES, label: str = "label") -> dict[str, float]:
    """One least-squares fit with intercept over all rows, whatever series they
    belong to: raw-feature weights and ``intercept``.

    A single aggregation sums means and co-moments of all features (merged task
    by task without cancellation), one row of 8 x 8 numbers solves the normal
    equations of the features scaled to unit variance (M1). A feature that does
    not vary gets weight 0; without rows every weight is 0.
    """
    f = list(features)
    co = [F.covar_pop(a, b).alias(f"{a}|{b}") for i, a in enumerate(f) for b in f[i:]]
    row = rows.agg(F.count(label).alias("_n"), *[F.avg(c).alias(f"{c}|") for c in [*f, label]], *co,
                   *[F.covar_pop(a, label).alias(f"{a}|{label}") for a in f]).collect()[0]
    if not row["_n"]:
        return {c: 0.0 for c in f} | {"intercept": 0.0}
    at = lambda a, b: row[f"{a}|{b}"] if f.index(a) <= f.index(b) else row[f"{b}|{a}"]
    gram = np.array([[at(a, b) for b in f] for a in f])
    std = np.sqrt(np.diag(gram).clip(min=0))
    able = std > 1e-12 * std.max(initial=0.0)
    unit = np.where(able, std, 1.0)
    moment = np.array([row[f"{a}|{label}"] for a in f]) / unit
    w = np.zeros(len(f))
    w[able] = np.linalg.lstsq((gram / np.outer(unit, unit))[np.ix_(able, able)], moment[able], rcond=None)[0]
    w = w / unit
    out = {c: float(x) for c, x in zip(f, w)}
    out["intercept"] = float(row[f"{label}|"] - sum(row[f"{c}|"] * x for c, x in zip(f, w)))
    return out


def fit_pooled_model(inp: Inputs, start, end) -> dict[str, float]:
    """M2 over all series pooled: one set of raw-feature weights, fitted on every
    station's daily entries, for ``series.recursive_forecast`` on any of them."""
    return pooled_regression(panel_training_rows(inp, start, end))


def fit_panel_trees(inp: Inputs, start, end, seed: int = 42) -> PipelineModel:
    """Scaler + gradient-boosted trees over every station's series at once (M2)."""
    return _pipeline(GBTRegressor(featuresCol="features", labelCol="label", maxDepth=4, maxIter=20, seed=seed),
                     panel_training_rows(inp, start, end))


def _pipeline(reg, rows: DataFrame) -> PipelineModel:
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(series.FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True),
        reg,
    ])
    # The fit passes over the rows several times (scaler statistics, solver
    # or boosting rounds): keep them instead of re-deriving them per pass.
    rows = rows.persist()
    try:
        return pipe.fit(rows)
    finally:
        rows.unpersist()


def total_coefficients(model: PipelineModel) -> dict[str, float]:
    """Raw-feature weights of a fitted scaler + regression (x / std, no centring)."""
    scaler, lr = model.stages[1], model.stages[2]
    std = scaler.std.toArray()
    coef = lr.coefficients.toArray()
    out = {f: (float(c / s) if s > 0 else 0.0) for f, c, s in zip(series.FEATURES, coef, std)}
    out["intercept"] = float(lr.intercept)
    return out


def coefficient_table(spark, coef: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(coef.items()), schemas.TOTAL_COEF)


def _entity_rows(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """(model, entity, cells): every entity with its day -> flow map (at most
    one cell per day of the history)."""
    cells = panel.groupBy("model", "entity").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.col("flow").cast("double").alias("v")))).alias("cells"))
    return entities.select("model", "entity").distinct().join(cells, ["model", "entity"], "left")


def _centred(batch, days: dict[str, np.ndarray]):
    """(model, row numbers, entities x days matrix, every row around its mean)
    of each model of a batch; ``days``: the model's days, numbered from 1970."""
    models = np.array(batch.column("model").to_pylist(), dtype=object)
    maps = batch.column("cells")
    offsets, keys, values = maps.offsets.to_numpy(), maps.keys.cast(pa.int32()).to_numpy(), maps.items.to_numpy()
    for model in dict.fromkeys(models.tolist()):
        if model not in days:
            continue
        at, own = np.flatnonzero(models == model), days[model]
        size = offsets[at + 1] - offsets[at]
        cell = np.repeat(offsets[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        a = np.zeros((len(at), len(own)))
        a[np.repeat(np.arange(len(at)), size), np.searchsorted(own, keys[cell])] = values[cell]
        yield model, at, a - a.mean(axis=1, keepdims=True)


def _gram_step(days: dict, blocks: dict):
    """mapInArrow step: per model the sum of a^T (a W) over the rows a of a task."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for model, _, a in _centred(batch, days):
                part = a.T @ (a @ blocks[model])
                sums[model] = sums[model] + part if model in sums else part
        for model, s in sums.items():
            n, width = s.shape
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([model] * (n * width)), "i": pa.array(np.repeat(np.arange(n, dtype=np.int32), width)),
                "j": pa.array(np.tile(np.arange(width, dtype=np.int32), n)), "v": pa.array(s.ravel())})
    return run


def _new_directions(block: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``block`` adds to ``known``."""
    size = np.linalg.norm(block)
    for _ in range(2):
        block = block - known @ (known.T @ block)
    q, r, = np.linalg.qr(block)
    u, s, _ = np.linalg.svd(r)
    q = q @ u[:, s > 1e-11 * max(size, 1e-300)]
    q = q - known @ (known.T @ q)
    return np.linalg.qr(q)[0][:, :max(0, len(known) - known.shape[1])]


def _loading_step(days: dict, axes: dict):
    """mapInArrow step: rows a -> loadings a V / S."""
    def run(batches):
        for batch in batches:
            for model, at, a in _centred(batch, days):
                w = a @ axes[model]
                n, k = w.shape
                names = batch.column("entity").take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_pydict({"model": pa.array([model] * (n * k), pa.string()), "entity": names,
                                                  "factor": pa.array(np.tile(np.arange(k, dtype=np.int32), n)), "weight": pa.array(w.ravel())})
    return run


def fit_basis(panel: DataFrame, entities: DataFrame, rank: int, oversample: int = 10, tol: float = 1e-10,
              passes: int = 40, seed: int = 42) -> DataFrame:
    """M4: principal axes of each model's days -> (model, entity, factor, weight).

    ``panel`` (model, entity, day, flow) supplies the training days (those with
    any flow), ``entities`` (model, entity) the rows of P, each around its mean.
    Entities may be many, days are few: a randomised block Krylov iteration
    starts from days x (rank + oversample) numbers per model, and each pass over
    the entity rows A adds up A^T A W for the newest block W task by task, until
    the leading ``rank`` axes hold to ``tol`` of the largest. The loadings are
    made in Spark, row by row; neither they nor an entities x entities matrix
    are ever gathered. The driver holds days x columns numbers. Axes have the sign
    that makes their largest day positive; a model of lower rank has fewer factors.
    """
    spark = panel.sparkSession
    path = scratch_path(spark, "entity-rows")
    rows = _entity_rows(panel, entities)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    days = {r["model"]: np.array(sorted(r["days"]))                                       # one number per day
            for r in panel.groupBy("model").agg(F.collect_set(F.unix_date("day")).alias("days")).collect()}
    rng = np.random.default_rng(seed)
    block = {m: np.linalg.qr(rng.normal(size=(len(d), min(len(d), rank + oversample))))[0] for m, d in sorted(days.items())}
    known = {m: np.zeros((len(d), 0)) for m, d in days.items()}                           # orthonormal columns so far
    image = {m: np.zeros((len(d), 0)) for m, d in days.items()}                           # A^T A of them
    axes: dict[str, tuple] = {}
    for _ in range(passes):
        if not block:
            break
        summed = rows.where(F.col("model").isin(*block)).mapInArrow(
            _gram_step({m: days[m] for m in block}, dict(block)), "model string, i int, j int, v double") \
            .groupBy("model", "i", "j").agg(F.sum("v").alias("v")).toArrow()              # days x (rank + oversample)
        names = np.array(summed.column("model").to_pylist(), dtype=object)
        i, j, v = (summed.column(c).to_numpy() for c in ("i", "j", "v"))
        for m in list(block):
            added, own = np.zeros_like(block[m]), names == m
            added[i[own], j[own]] = v[own]
            known[m], image[m] = np.hstack([known[m], block[m]]), np.hstack([image[m], added])
            small = known[m].T @ image[m]
            e, turn = np.linalg.eigh((small + small.T) / 2)
            e, turn = e[::-1][:rank].clip(min=0), turn[:, ::-1][:, :rank]
            right = known[m] @ turn
            axes[m] = (right, np.sqrt(e))
            rest = np.linalg.norm(image[m] @ turn - right * e, axis=0).max(initial=0.0)
            block[m] = _new_directions(added, known[m])
            if rest <= tol * e.max(initial=0.0) or not block[m].shape[1]:
                del block[m]
    made = {}
    for m, (right, s) in axes.items():
        able = s > 1e-7 * s.max(initial=0.0)         # the square roots of 1e-14
        right, s = right[:, able], s[able]
        sign = np.sign(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])]) if right.size else np.ones(0)
        made[m] = right * sign / s
    return rows.mapInArrow(_loading_step(days, made), schemas.BASIS)


def factor_series(panel: DataFrame, basis: DataFrame) -> DataFrame:
    """(model, factor, day, q): the projected factor series over the days of
    the model's panel, gap days 0."""
    q = lowrank.project(panel, lowrank.projection_weights(basis))
    q = q.groupBy("model", "day").agg(F.map_from_entries(F.collect_list(F.struct("factor", "q"))).alias("m"))   # k numbers
    days = F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")
    factors = basis.groupBy("model").agg(F.sort_array(F.collect_set("factor")).alias("factors"))
    grid = q.groupBy("model").agg(days).join(F.broadcast(factors), "model")         # models x k numbers: bounded
    filled = F.transform("factors", lambda f: F.struct(f.alias("factor"), F.coalesce(F.element_at("m", f), F.lit(0.0)).alias("q")))
    return grid.join(q, ["model", "day"], "left").select("model", "day", F.explode(filled).alias("c")) \
        .select("model", "c.factor", "day", "c.q")


def _least_squares(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of y ~ x without intercept: the shortest least-squares solution,
    or with ``ridge`` the minimum of |x w - y|^2 / rows + ridge |w|^2."""
    if ridge:
        rows = np.sqrt(ridge * max(len(x), 1)) * np.eye(x.shape[1])
        x, y = np.vstack([x, rows]), np.concatenate([y, np.zeros((x.shape[1], *y.shape[1:]))])
    return np.linalg.lstsq(x, y, rcond=None)[0]


def _solve_own(window: int, ridge: float):
    """applyInArrow step: one factor's series -> its AR weights."""
    def run(table):
        q = table.sort_by("day").column("q").to_numpy()
        x = np.stack([q[window - lag:len(q) - lag] for lag in range(1, window + 1)], axis=1) if len(q) > window else np.zeros((0, window))
        w = _least_squares(x, q[window:], ridge) if len(x) else np.zeros(0)
        n = len(w)
        return pa.table({"model": table.column("model").slice(0, 1).combine_chunks().take(pa.array([0] * n, pa.int64())),
                         "factor": table.column("factor").slice(0, 1).combine_chunks().take(pa.array([0] * n, pa.int64())),
                         "lag": pa.array(range(1, n + 1), pa.int32()), "weight": pa.array(w, pa.float64())})
    return run


def _solve_across(window: int, ridge: float):
    """applyInArrow step: a model's factor series -> AR weights across factors."""
    def run(table):
        table = table.sort_by([("day", "ascending"), ("factor", "ascending")])
        factors = np.unique(table.column("factor").to_numpy())
        k = len(factors)
        if k * window > MAX_WEIGHTS:
            raise ValueError(f"{k} factors x {window} lags: at most {MAX_WEIGHTS} weights per factor")
        q = table.column("q").to_numpy().reshape(-1, k)                             # days x factors
        x = np.concatenate([q[window - lag:len(q) - lag] for lag in range(1, window + 1)], axis=1) if len(q) > window else np.zeros((0, 1))
        w = _least_squares(x, q[window:], ridge) if len(x) else np.zeros((0, k))    # (lag, source) x factor
        place = np.arange(len(w))
        return pa.table({"model": pa.array([table.column("model")[0].as_py()] * w.size), "factor": pa.array(np.tile(factors, len(w)), pa.int32()),
                         "lag": pa.array(np.repeat(place // k + 1, k), pa.int32()), "source": pa.array(np.repeat(factors[place % k], k), pa.int32()),
                         "weight": pa.array(w.ravel(), pa.float64())})
    return run


def fit_factor_ar(panel: DataFrame, basis: DataFrame, window: int = lowrank.WINDOW_DAYS,
                  reg_param: float = 0.0) -> DataFrame:
    """M6: AR weights of each factor on its own last ``window`` values, without
    intercept -> (model, factor, lag, weight). The factor series are made in one
    pass over the panel; every (model, factor) is then one small group, of one
    number per day, that is solved where it lies."""
    solve = _solve_own(window, reg_param)
    return factor_series(panel, basis).groupBy("model", "factor").applyInArrow(solve, schemas.AR_COEF)


def fit_cross_factor_ar(panel: DataFrame, basis: DataFrame, window: int = lowrank.WINDOW_DAYS,
                        reg_param: float = 1e-3) -> DataFrame:
    """M6 with weights across factors, as a step that sees the whole window x k
    history: every factor on the last ``window`` values of all factors, without
    intercept -> (model, factor, lag, source, weight). A model is one group of
    days x k numbers; ``reg_param`` keeps its window x k weights per factor
    determined when there are fewer days."""
    solve = _solve_across(window, reg_param)
    return factor_series(panel, basis).groupBy("model").applyInArrow(solve, schemas.CROSS_AR_COEF)
