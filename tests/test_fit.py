"""Distributed fits against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import oracles as O
from metrolens import schemas
from metrolens.operators import lowrank, series
from metrolens.plans import fit as FIT
from metrolens.plans import forecast as FC

DAY0 = dt.date(2024, 1, 1)


def panel_of(spark, matrices):
    """matrices: model -> entities x days; zero cells are absent."""
    rows = [(m, f"e{i:04d}", DAY0 + dt.timedelta(days=j), float(a[i, j])) for m, a in matrices.items()
            for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    ents = [(m, f"e{i:04d}") for m, a in matrices.items() for i in range(a.shape[0])]
    return spark.createDataFrame(rows, schemas.MATRIX).repartition(5), spark.createDataFrame(ents, "model string, entity string")


def loadings(df, matrices):
    out = {}
    for m, a in matrices.items():
        rows = [r for r in df if r["model"] == m]
        p = np.zeros((a.shape[0], max([r["factor"] for r in rows], default=-1) + 1))
        for r in rows:
            p[int(r["entity"][1:]), r["factor"]] = r["weight"]
        out[m] = p
    return out


def test_basis_is_the_leading_subspace(spark):
    rng = np.random.default_rng(0)
    low = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 60)) * 20 + rng.normal(size=(120, 60)) + 50
    matrices = {"noisy": low, "few days": rng.normal(size=(40, 5)) + 9, "flat": rng.normal(size=(70, 90)),
                "rank one": np.outer(np.arange(1.0, 31.0), np.arange(1.0, 25.0))}
    matrices["noisy"][7] = 0.0                                     # an entity without any flow
    panel, ents = panel_of(spark, matrices)
    got = loadings(FIT.fit_basis(panel, ents, 3).collect(), matrices)
    for m, a in matrices.items():
        c = a - a.mean(axis=1, keepdims=True)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        k = 1 if m == "rank one" else 3
        p = got[m]
        assert p.shape == (len(a), k)
        assert np.abs(p.T @ p - np.eye(k)).max() < 1e-9
        assert np.abs(np.abs(np.sum(p * u[:, :k], axis=0)) - 1).max() < 1e-8, m      # each axis, up to its sign
    assert not got["noisy"][7].any()


def test_pooled_regression_matches_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * [1, 5, 100, 1, 1, 1, 0.01, 3] + [0, 1000, 5, 0, 0, 0, 0, 0]
    x[:, 4] = 2.0                                                  # does not vary
    y = x @ rng.normal(size=8) + 7 + rng.normal(size=500)
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*series.FEATURES, "label"]).repartition(4)
    got = FIT.pooled_regression(rows)
    use = [i for i in range(8) if i != 4]
    want = np.linalg.lstsq(np.column_stack([x[:, use], np.ones(500)]), y, rcond=None)[0]
    assert np.allclose([got[series.FEATURES[i]] for i in use], want[:-1], rtol=1e-8) and got[series.FEATURES[4]] == 0.0
    assert abs(got["intercept"] - want[-1]) < 1e-6
    assert set(FIT.pooled_regression(rows.limit(0)).values()) == {0.0}


def test_pooled_model_scores_all_stations_at_once(spark):
    sf = "/root/testdata/sf0.001"
    inp = E.od_inputs(spark, sf)
    coef = FIT.fit_pooled_model(inp, O.OD_START, O.OD_TRAIN_END)
    rows = FIT.panel_training_rows(inp, O.OD_START, O.OD_TRAIN_END)
    score = sum((F.col(c) * coef[c] for c in series.FEATURES), F.lit(coef["intercept"]))
    rest = rows.withColumn("rest", F.col("label") - score).agg(
        F.sum("rest").alias("one"), *[F.sum(F.col("rest") * F.col(c)).alias(c) for c in series.FEATURES],
        F.avg(F.pow("rest", F.lit(2))).alias("mse"), F.var_pop("label").alias("var")).collect()[0].asDict()
    mse, var = rest.pop("mse"), rest.pop("var")
    assert max(map(abs, rest.values())) < 1e-6 and mse < var       # residuals are orthogonal to every feature
    fc = E.forecast_panel_fitted(spark, sf).collect()
    assert len(fc) == 25 * O.FORECAST_STEPS


def factor_panel(spark, k, t, seed):
    """A panel whose projection on the identity-like basis is a given series."""
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(k, t)).cumsum(axis=1) + 5
    panel, _ = panel_of(spark, {"m": q})
    basis = spark.createDataFrame([("m", f"e{i:04d}", i, 1.0) for i in range(k)], schemas.BASIS)
    return q, panel, basis


def test_grouped_ar_matches_lstsq(spark):
    q, panel, basis = factor_panel(spark, 3, 60, 2)
    for window, ridge in ((1, 0.0), (5, 0.0), (5, 0.1)):
        got = {(r["factor"], r["lag"]): r["weight"] for r in FIT.fit_factor_ar(panel, basis, window, ridge).collect()}
        assert len(got) == 3 * window
        for f in range(3):
            x = np.stack([q[f, window - lag:60 - lag] for lag in range(1, window + 1)], axis=1)
            y = q[f, window:]
            want = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(window), x.T @ y)
            assert np.allclose([got[f, lag] for lag in range(1, window + 1)], want, rtol=1e-6, atol=1e-8)
    assert FIT.fit_factor_ar(panel, basis, window=60).count() == 0          # no day has that much history


def test_cross_factor_ar_matches_lstsq_and_forecasts(spark):
    q, panel, basis = factor_panel(spark, 3, 60, 3)
    coef = FIT.fit_cross_factor_ar(panel, basis, window=4, reg_param=0.01)
    got = {(r["factor"], r["lag"], r["source"]): r["weight"] for r in coef.collect()}
    x = np.concatenate([q[:, 4 - lag:60 - lag] for lag in range(1, 5)]).T
    want = np.linalg.solve(x.T @ x + 0.01 * len(x) * np.eye(12), x.T @ q[:, 4:].T)
    for (f, lag, g), w in got.items():
        assert abs(w - want[(lag - 1) * 3 + g, f]) < 1e-8
    assert len(got) == 36
    history = [q[:, t] for t in range(60)]
    for _ in range(3):                                             # clipped and rounded, then seen by the next step
        step = np.concatenate([history[-lag] for lag in range(1, 5)]) @ want
        history.append(np.round(np.maximum(step, 0.0)))
    fc = lowrank.low_rank_forecast(panel, basis, coef, DAY0 + dt.timedelta(days=60), n=3).collect()
    assert {(int(r["entity"][1:]), (r["day"] - DAY0).days): r["flow"] for r in fc} == {
        (f, t): int(history[t][f]) for f in range(3) for t in range(60, 63)}
    one = lowrank.next_factors(lowrank.project(panel, lowrank.projection_weights(basis)), coef, DAY0 + dt.timedelta(days=60)).collect()
    assert np.allclose([r["q"] for r in sorted(one, key=lambda r: r["factor"])], np.concatenate([q[:, 60 - lag] for lag in range(1, 5)]) @ want)


def test_cross_factor_weights_are_bounded(spark, monkeypatch):
    _, panel, basis = factor_panel(spark, 3, 12, 4)
    monkeypatch.setattr(FIT, "MAX_WEIGHTS", 11)
    with pytest.raises(Exception, match="weights per factor"):
        FIT.fit_cross_factor_ar(panel, basis, window=4).collect()


@pytest.mark.parametrize("singular", [(1, 1e-3, 1e-6, 1e-8), (1, 1e-3, 1e-5, 1e-9), (1, 1e-6, 1e-9, 1e-11), (1, 1, 1, 0)])
def test_projection_of_ill_conditioned_bases(spark, monkeypatch, singular):
    """Forecasts equal numpy's pinv pipeline also where P^T P is singular to double precision."""
    monkeypatch.setattr(lowrank, "BLOCK_ROWS", 13)                 # several blocks per task
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.normal(size=(100, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    p = (u * singular) @ v.T
    a = np.round(rng.gamma(2.0, 30.0, size=(100, 28)))
    panel, _ = panel_of(spark, {"m": a})
    basis = spark.createDataFrame([("m", f"e{i:04d}", j, float(p[i, j])) for i in range(100) for j in range(4)], schemas.BASIS)
    rec = lowrank.reconstruct_panel(lowrank.project(panel, lowrank.projection_weights(basis)), basis).collect()
    got = np.zeros((100, 28))
    for r in rec:
        got[int(r["entity"][1:]), (r["day"] - DAY0).days] = r["value"]
    space = np.linalg.qr(p[:, :] @ v)[0][:, :sum(s > 0 for s in singular)]            # of P as it is stored
    least = min(s for s in singular if s)
    assert np.abs(got - space @ (space.T @ a)).max() < max(1e-6, 1e-13 / least)       # what factors of size 1 / least allow
    coef = spark.createDataFrame([("m", f, lag, 0.5) for f in range(4) for lag in (1, 7)], schemas.AR_COEF)
    fc = lowrank.low_rank_forecast(panel, basis, coef, DAY0 + dt.timedelta(days=28)).collect()
    q = np.linalg.pinv(p) @ a
    want = np.round(np.maximum(p @ (0.5 * q[:, -1] + 0.5 * q[:, -7]), 0.0))
    off = [abs(int(r["flow"]) - want[int(r["entity"][1:])]) for r in fc]
    assert max(off) <= (least < 1e-10) and sum(off) <= (least < 1e-10)


def test_multi_step_plan_collects_nothing(spark, monkeypatch):
    from pyspark.sql import DataFrame
    inp = E.ev_inputs(spark, "/root/testdata/sf0.001")
    basis, coef = E._station_params(spark, inp, FC.STATION_SERIES)

    def refuse(*_):
        raise AssertionError("collected while the plan was built")
    for name in ("collect", "toPandas", "toArrow", "count", "first", "head", "take"):
        monkeypatch.setattr(type(basis), name, refuse)
        monkeypatch.setattr(DataFrame, name, refuse)
    plan = lowrank.low_rank_forecast(FC.station_panel(inp, O.EV_FORECAST_START), basis, coef, O.EV_FORECAST_START, n=7)
    assert plan.columns == ["model", "entity", "day", "flow"]


def test_models_of_other_rank_and_without_weights(spark):
    """Models of different rank in one job; a model without AR weights forecasts 0."""
    panel, _ = panel_of(spark, {"a": np.full((3, 28), 4.0), "b": np.full((2, 28), 7.0)})
    basis = spark.createDataFrame([("a", f"e{i:04d}", 0, 1.0) for i in range(3)] + [("b", f"e{i:04d}", 5 + j, float(i == j)) for i in range(2) for j in range(2)],
                                  schemas.BASIS)
    coef = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 9, 1, 1.0), ("a", 0, 99, 5.0)], schemas.AR_COEF)
    fc = lowrank.low_rank_forecast(panel, basis, coef, DAY0 + dt.timedelta(days=28), n=2).collect()
    assert {(r["model"], r["flow"]) for r in fc} == {("a", 4), ("b", 0)} and len(fc) == 10
