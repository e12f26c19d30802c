"""Daily series operators: densify (C10/D14), pivot (D13), lag features
(E1/E2) and the recursive one-step-ahead fold (E6).

Series are long DataFrames ``(keys..., day, flow)``. Windows are always
partitioned by the series key and hold one row per day, so a window task
is bounded by the history length, never by trip volume.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolens.functions.dates import as_date, date_str
from metrolens.session import reliable_checkpoint

# The reference's one-step regression features, in its order:
# is_workday, lags of 1, 4, 7, 14, 21, 28 days, and lag 1 minus lag 29.
LAGS = (1, 4, 7, 14, 21, 28)
TREND_LAG = 29
FEATURES = ("is_workday",) + tuple(f"lag_{n}" for n in LAGS) + ("trend",)


def days_column(lo, hi) -> Column:
    return F.explode(F.sequence(F.lit(as_date(lo)), F.lit(as_date(hi))))


def densify_range(series: DataFrame, entities: DataFrame, keys: Sequence[str], lo, hi,
                  value: str = "flow") -> DataFrame:
    """Every entity x every day of ``[lo, hi]``, missing values 0.

    The grid is generated from the (bounded) entity table with a
    ``sequence`` generator, then outer-joined on the keys.
    """
    grid = entities.select(*keys).distinct().withColumn("day", days_column(lo, hi))
    return (grid.join(series, [*keys, "day"], "left")
            .select(*keys, "day", F.coalesce(F.col(value), F.lit(0)).alias(value)))


def densify_span(series: DataFrame, keys: Sequence[str], value: str = "flow") -> DataFrame:
    """Zero-fill the gap days inside each key's own first..last day."""
    span = series.groupBy(*keys).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("day"))
    return (grid.join(series, [*keys, "day"], "left")
            .select(*keys, "day", F.coalesce(F.col(value), F.lit(0)).alias(value)))


def pivot_days(series: DataFrame, key: str, lo, hi, value: str = "flow") -> DataFrame:
    """Wide entity x day matrix with one column per ISO date.

    The column list is given explicitly, so Spark needs no extra pass to
    find the pivot values.
    """
    lo, hi = as_date(lo), as_date(hi)
    days = [(lo + dt.timedelta(days=i)).isoformat() for i in range((hi - lo).days + 1)]
    return (series.withColumn("_d", date_str("day"))
            .groupBy(key).pivot("_d", days).agg(F.sum(value)).na.fill(0, subset=days))


def lag_features(series: DataFrame, keys: Sequence[str], value: str = "flow") -> DataFrame:
    """Lag features per series on a densified daily series.

    Adds lag_1 .. lag_28 and ``trend`` = lag_1 - lag_29 (null where the
    history is too short, as the reference's row shifts were).
    """
    w = Window.partitionBy(*keys).orderBy("day")
    cols = [F.lag(value, n).over(w).alias(f"lag_{n}") for n in LAGS]
    trend = (F.lag(value, 1).over(w) - F.lag(value, TREND_LAG).over(w)).alias("trend")
    return series.select(*keys, "day", value, *cols, trend)


def recursive_forecast(series: DataFrame, calendar: DataFrame | None, keys: Sequence[str],
                       coef: Mapping[str, float], start, n: int, entities: DataFrame | None = None) -> DataFrame:
    """n-step recursive forecast of a linear one-step model.

    ``coef`` maps FEATURES and "intercept" to weights on the raw features; for
    the rest see :func:`recursive_fold`.
    """
    w = {k: float(coef.get(k, 0.0)) for k in (*FEATURES, "intercept")}

    def predict(x: Mapping[str, Column]) -> Column:
        y = F.lit(w["intercept"])
        for f in FEATURES:
            y = y + F.lit(w[f]) * x[f]
        return y
    return recursive_fold(series, calendar, keys, predict, start, n, entities)


def recursive_forecast_trees(series: DataFrame, calendar: DataFrame | None, keys: Sequence[str],
                             trees: "Trees", start, n: int, entities: DataFrame | None = None) -> DataFrame:
    """The same with a fitted tree ensemble (M3): the trees are array literals
    walked inside the fold, so every series is forecast in one pass, without a
    model call or a checkpoint per step."""
    return recursive_fold(series, calendar, keys, lambda x: trees.predict([x[f] for f in FEATURES]), start, n, entities)


@dataclass(frozen=True)
class Trees:
    """A sum of regression trees over FEATURES as flat arrays, one entry per
    node, all trees in one: ``feature`` (-1 at a leaf), ``threshold`` (left if
    the feature is at most that), ``left``, ``right``, ``value``; ``roots`` and
    ``weights`` per tree, ``depth`` of the deepest, and ``scale``, which every
    feature is multiplied with first."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    weights: list[float]
    depth: int
    scale: list[float]

    def predict(self, features: Sequence[Column]) -> Column:
        def ints(values) -> Column:
            return F.lit([int(v) for v in values]).cast("array<int>")

        def doubles(values) -> Column:
            return F.lit([float(v) for v in values]).cast("array<double>")
        feature, left, right = ints(self.feature), ints(self.left), ints(self.right)
        threshold, value, weights = doubles(self.threshold), doubles(self.value), doubles(self.weights)
        scaled = F.array(*[f * F.lit(float(s)) for f, s in zip(features, self.scale)])

        def down(x: Column, node: Column) -> Column:
            f = F.get(feature, node)
            return F.when(f < 0, node).when(F.get(x, f) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))

        def score(x: Column) -> Column:
            leaves = F.transform(ints(self.roots), lambda root: F.aggregate(
                F.sequence(F.lit(1), F.lit(max(1, self.depth))), root, lambda node, _: down(x, node)))
            return F.aggregate(F.zip_with(leaves, weights, lambda leaf, w: F.get(value, leaf) * w), F.lit(0.0), lambda s, v: s + v)
        # one element: the scaled features are computed once and bound to x
        return F.get(F.transform(F.array(scaled), score), 0)


def recursive_fold(series: DataFrame, calendar: DataFrame | None, keys: Sequence[str],
                   predict: Callable[[Mapping[str, Column]], Column], start, n: int,
                   entities: DataFrame | None = None) -> DataFrame:
    """n-step recursive forecast with ``predict``, an expression over FEATURES.

    Every row of ``entities`` (keys) gets a forecast, also a series without
    any flow; without ``entities`` the series of ``series`` do.

    ``series`` has (keys, day, flow) with flows for the 29 days before
    ``start`` (missing days count 0); ``calendar`` has (time, workday).
    Each step predicts ``round_half_even(predict(features))`` and appends it
    to the history, so later steps see earlier predictions; the fold runs
    inside one row per series with Spark's ``aggregate`` - no Python, no
    driver loop. Returns (keys, day, is_workday, flow).
    """
    start = as_date(start)
    hist_lo = start - dt.timedelta(days=TREND_LAG)
    hi = start + dt.timedelta(days=n - 1)
    ents = (series if entities is None else entities).select(*keys).distinct()
    grid = ents.withColumn("day", days_column(hist_lo, hi))
    flags = None
    if calendar is not None:
        flags = (calendar.where(F.col("time").between(F.lit(start), F.lit(hi)))
                 .groupBy(F.col("time").alias("day"))
                 .agg(F.max((F.col("workday") == 1).cast("double")).alias("is_workday")))
    rows = grid.join(series.where(F.col("day").between(F.lit(hist_lo), F.lit(start - dt.timedelta(days=1)))),
                     [*keys, "day"], "left")
    # flags: one row per forecast day (n rows) - a bounded broadcast; joining
    # on a key with n values must not shuffle the whole panel onto n tasks.
    rows = rows.join(F.broadcast(flags), "day", "left") if flags is not None \
        else rows.withColumn("is_workday", F.lit(None))
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("day", F.col("flow").cast("double").alias("flow"),
                 F.col("is_workday").cast("double").alias("wd")))).alias("r"))

    hist0 = F.transform(F.slice("r", 1, TREND_LAG), lambda x: F.coalesce(x["flow"], F.lit(0.0)))
    wd = F.transform(F.slice("r", TREND_LAG + 1, n), lambda x: F.coalesce(x["wd"], F.lit(0.0)))

    def step(acc: Column, i: Column) -> Column:
        def lag(m: int) -> Column:
            return F.element_at(acc, -m)
        x = {"is_workday": F.element_at(wd, i + 1), "trend": lag(1) - lag(TREND_LAG)} | {f"lag_{m}": lag(m) for m in LAGS}
        return F.concat(acc, F.array(F.bround(predict(x), 0)))

    folded = packed.select(*keys, wd.alias("wd"),
                           F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), hist0, step).alias("h"))
    out = folded.select(*keys, "wd", F.posexplode(F.slice("h", TREND_LAG + 1, n)).alias("i", "flow"))
    return out.select(*keys, F.date_add(F.lit(start), F.col("i")).alias("day"),
                      F.element_at("wd", F.col("i") + 1).cast("int").alias("is_workday"),
                      F.col("flow").cast("long").alias("flow"))


def step_features(history: DataFrame, calendar: DataFrame | None, keys: Sequence[str], target) -> DataFrame:
    """One row per series with the reference's features for ``target``
    (is_workday, lags 1..28, lag 1 - lag 29), read from a daily history."""
    target = as_date(target)

    def at(m: int) -> Column:
        day = F.lit(target - dt.timedelta(days=m))
        return F.coalesce(F.max(F.when(F.col("day") == day, F.col("flow").cast("double"))), F.lit(0.0))
    lo = target - dt.timedelta(days=TREND_LAG)
    feats = (history.where(F.col("day").between(F.lit(lo), F.lit(target - dt.timedelta(days=1))))
             .groupBy(*keys).agg(*[at(m).alias(f"lag_{m}") for m in LAGS],
                                 (at(1) - at(TREND_LAG)).alias("trend")))
    wd = F.lit(0.0)
    if calendar is not None:
        # the target day's flag is one value: a scalar subquery, not a join
        wd = F.coalesce(calendar.where(F.col("time") == F.lit(target))
                        .agg(F.max((F.col("workday") == 1).cast("double"))).scalar(), F.lit(0.0))
    return feats.withColumn("is_workday", wd)


def recursive_forecast_model(series: DataFrame, calendar: DataFrame | None, keys: Sequence[str],
                             model, start, n: int, entities: DataFrame | None = None) -> DataFrame:
    """n-step recursive forecast with any fitted Spark ML model (M3 for
    non-linear regressors, e.g. gradient-boosted trees).

    Each step builds the target day's features per series from the
    history, scores them with ``model.transform`` (the model's pipeline
    assembles ``FEATURES`` itself), rounds half to even and appends the
    prediction; the history is cut from its lineage every step by a reliable
    checkpoint in the shared folder. ``entities`` as in ``recursive_forecast``.
    Returns (keys, day, is_workday, flow).
    """
    start = as_date(start)
    cut = reliable_checkpoint(series.sparkSession)
    lo = start - dt.timedelta(days=TREND_LAG)
    ents = (series if entities is None else entities).select(*keys).distinct()
    hist = (ents.withColumn("day", days_column(lo, start - dt.timedelta(days=1)))
            .join(series.where(F.col("day") >= F.lit(lo)), [*keys, "day"], "left")
            .select(*keys, "day", F.coalesce(F.col("flow"), F.lit(0)).cast("double").alias("flow"),
                    F.lit(None).cast("int").alias("is_workday")))
    hist = cut(hist)
    for i in range(n):
        target = start + dt.timedelta(days=i)
        feats = step_features(hist, calendar, keys, target)
        pred = (model.transform(feats)
                .select(*keys, F.lit(target).alias("day"),
                        F.bround(F.col("prediction"), 0).alias("flow"),
                        F.col("is_workday").cast("int").alias("is_workday")))
        hist = cut(hist.unionByName(pred))
    return (hist.where(F.col("day") >= F.lit(start))
            .select(*keys, "day", "is_workday", F.col("flow").cast("long").alias("flow")))
