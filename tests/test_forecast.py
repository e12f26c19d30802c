"""Series operators, rounding, low-rank algebra and recursive forecasts."""

import datetime as dt
import os

import numpy as np
import pytest
from conftest import trips_df
from pyspark.sql import functions as F

from metrolens import schemas
from metrolens.functions.numeric import clip_round, round_even
from metrolens.operators import lowrank, series
from metrolens.plans import forecast as FC
from metrolens.plans.inputs import Inputs


def test_rounding_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.2,)], "x double")
    out = df.select(round_even(F.col("x")).alias("r"), clip_round(F.col("x")).alias("c")).collect()
    assert [r["r"] for r in out] == [0.0, 2.0, 2.0, -0.0, -1.0]
    assert [r["c"] for r in out] == [0.0, 2.0, 2.0, 0.0, 0.0]


def _series(spark, values, start="2024-01-01", key="s"):
    d0 = dt.date.fromisoformat(start)
    return spark.createDataFrame([(key, d0 + dt.timedelta(days=i), v) for i, v in enumerate(values) if v is not None],
                                 "series string, day date, flow long")


def test_densify_and_lags(spark):
    s = _series(spark, [5, None, 7, None, None, 3])
    dense = series.densify_span(s, ["series"]).orderBy("day").collect()
    assert [r["flow"] for r in dense] == [5, 0, 7, 0, 0, 3]
    feats = series.lag_features(series.densify_span(s, ["series"]), ["series"]).orderBy("day").collect()
    assert feats[-1]["lag_1"] == 0 and feats[-1]["lag_4"] == 0 and feats[-1]["lag_7"] is None
    assert feats[2]["lag_1"] == 0 and feats[5]["lag_4"] == 0 and feats[5]["trend"] is None


def _python_fold(hist, flags, coef, n):
    h = list(map(float, hist))
    out = []
    for i in range(n):
        y = coef.get("intercept", 0.0) + coef.get("is_workday", 0.0) * flags[i]
        for m in series.LAGS:
            y += coef.get(f"lag_{m}", 0.0) * h[-m]
        y += coef.get("trend", 0.0) * (h[-1] - h[-29])
        y = float(np.round(y))          # numpy rounds half to even
        h.append(y)
        out.append(y)
    return out


def test_recursive_forecast_matches_python(spark):
    rng = np.random.default_rng(7)
    hist = rng.integers(0, 50, 29).tolist()
    start = dt.date(2024, 3, 1)
    s = _series(spark, hist, start=(start - dt.timedelta(days=29)).isoformat())
    cal = spark.createDataFrame([(start + dt.timedelta(days=i), i % 2) for i in range(5)], schemas.WORKDAYS)
    coef = {"intercept": 1.25, "is_workday": 2.0, "lag_1": 0.4, "lag_7": 0.3, "lag_28": 0.2, "trend": 0.05}
    got = [r["flow"] for r in series.recursive_forecast(s, cal, ["series"], coef, start, 5).orderBy("day").collect()]
    assert got == _python_fold(hist, [0, 1, 0, 1, 0], coef, 5)


def _panel_and_basis(spark, rng, n_ent=12, k=3, days=28, start=dt.date(2024, 2, 1)):
    a = rng.integers(0, 20, (n_ent, days)).astype(float)
    p = rng.normal(size=(n_ent, k))
    ents = [f"e{i:02d}" for i in range(n_ent)]
    d0 = start - dt.timedelta(days=days)
    panel = spark.createDataFrame(
        [("m", ents[i], d0 + dt.timedelta(days=j), float(a[i, j])) for i in range(n_ent) for j in range(days)],
        schemas.MATRIX)
    basis = spark.createDataFrame([("m", ents[i], f, float(p[i, f])) for i in range(n_ent) for f in range(k)],
                                  schemas.BASIS)
    return a, p, ents, panel, basis, d0


def test_projection_matches_numpy_pinv(spark):
    rng = np.random.default_rng(1)
    a, p, ents, panel, basis, d0 = _panel_and_basis(spark, rng)
    q = lowrank.project(panel, lowrank.projection_weights(basis)).collect()
    expect = np.linalg.pinv(p) @ a
    got = np.zeros_like(expect)
    for r in q:
        got[r["factor"], (r["day"] - d0).days] = r["q"]
    assert np.allclose(got, expect, atol=1e-9)


def _projected(spark, p, a):
    """pinv(P) A and P pinv(P) A of one model and one day."""
    day = dt.date(2024, 1, 1)
    ents = [f"e{i}" for i in range(len(p))]
    basis = spark.createDataFrame([("m", e, f, float(w)) for e, row in zip(ents, p) for f, w in enumerate(row)], schemas.BASIS)
    panel = spark.createDataFrame([("m", e, day, float(v)) for e, v in zip(ents, a)], schemas.MATRIX)
    q = lowrank.project(panel, lowrank.projection_weights(basis))
    rec = {r["entity"]: r["value"] for r in lowrank.reconstruct(q.drop("day"), basis).collect()}
    return {r["factor"]: r["q"] for r in q.collect()}, [rec[e] for e in ents]


@pytest.mark.parametrize("p", [
    [[1e7, 0], [1e7, 0], [0, 1], [0, 1]],              # scales 1 : 10^7
    [[1.0], [0.0]],                                    # an all-zero row
    [[1, 1], [1, 1], [2, 2]],                          # rank 1
    [[0.0, 0.0], [0.0, 0.0]],
])
def test_projection_of_odd_bases_matches_numpy(spark, p):
    p, a = np.array(p, float), np.full(len(p), 10.0)
    q, rec = _projected(spark, p, a)
    expect = np.linalg.pinv(p) @ a
    assert np.allclose([q.get(f, 0.0) for f in range(p.shape[1])], expect, atol=1e-9)
    assert np.allclose(rec, p @ expect, atol=1e-6)


def test_rank_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "MAX_RANK", 2)
    basis = spark.createDataFrame([("m", "e", f, 1.0) for f in range(3)], schemas.BASIS)
    with pytest.raises(Exception, match="more than 2 factors"):
        lowrank.projection_weights(basis).collect()


def test_python_steps_travel_to_the_workers(tmp_path):
    """A low-rank query started from another folder, without PYTHONPATH."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from pyspark.sql import SparkSession\n"
            f"spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            f".config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', E.queries()['basis_project'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_stations_without_basis_row_or_trips_get_zero(spark):
    t = "2024-01-20T08:00:00"
    trips = trips_df(spark, [(t, t, "A", "B", "L", "L")] * 4)
    st = spark.createDataFrame([(1, "A", "L", None, 1), (2, "B", "L", None, 2), (3, "Z", "L", None, 3)], schemas.STATIONS)
    inp = Inputs(trips, stations=st)
    known = st.where("station_name <> 'Z'")
    coef = spark.createDataFrame([(m, 0, 1, 1.0) for m in (*FC.STATION_SERIES, *FC.PEAK_SERIES)], schemas.AR_COEF)
    basis = lambda series: FC.model_entities(known, "station_name", series).select(
        "model", "entity", F.lit(0).alias("factor"), F.lit(1.0).alias("weight"))
    out = {r["station"]: (r["flow_in"], r["flow_out"]) for r in
           FC.predict_stations_flow(inp, "2024-01-21", basis(FC.STATION_SERIES), coef).collect()}
    assert out == {"A": (2, 2), "B": (2, 2), "Z": (0, 0)}
    rows = FC.predict_single_station_flow(inp, "Z", "2024-01-21", basis(FC.STATION_SERIES), coef, n=3).collect()
    assert [(r["direction"], r["time"], r["flow"]) for r in rows] == [
        (d, f"2024-01-2{i}", 0) for d in ("in", "out") for i in (1, 2, 3)]
    peak = FC.predict_peak_flow(inp, "2024-01-21", basis(FC.PEAK_SERIES), coef).collect()
    assert {(r["period"], r["station"]): (r["flow_in"], r["flow_out"]) for r in peak}[("evening", "Z")] == (0, 0)
    assert len(peak) == 6
    empty = FC.predict_total_flow(inp.with_(trips=trips.limit(0)), "2024-01-21", 3, {"lag_1": 1.0}).collect()
    assert [r["flow"] for r in empty] == [0, 0, 0]


def test_full_rank_basis_reconstructs_identity(spark):
    rng = np.random.default_rng(2)
    a, p, ents, panel, basis, d0 = _panel_and_basis(spark, rng, n_ent=5, k=5)
    q = lowrank.project(panel, lowrank.projection_weights(basis))
    rec = lowrank.reconstruct(q.where(F.col("day") == d0).drop("day"), basis).collect()
    got = {r["entity"]: r["value"] for r in rec}
    assert np.allclose([got[e] for e in ents], a[:, 0], atol=1e-9)


def _numpy_lowrank(a, p, ar, n):
    """The reference's loop with a per-factor AR in place of the network."""
    a = a.copy()
    outs = []
    pinv = np.linalg.pinv(p)
    for _ in range(n):
        q = (pinv @ a[:, -28:]).T                  # 28 x k
        qn = sum(w * q[-lag] for lag, w in ar.items())
        pred = np.round(np.clip(p @ qn, 0, None))
        a = np.concatenate([a, pred[:, None]], axis=1)
        outs.append(pred)
    return np.array(outs)


def test_multi_step_low_rank_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, p, ents, panel, basis, d0 = _panel_and_basis(spark, rng)
    ar = {1: 0.55, 2: 0.2, 7: 0.15}
    coef = spark.createDataFrame([("m", f, lag, w) for f in range(p.shape[1]) for lag, w in ar.items()],
                                 schemas.AR_COEF)
    start = d0 + dt.timedelta(days=28)
    fc = lowrank.low_rank_forecast(panel, basis, coef, start, n=4).collect()
    got = np.zeros((4, len(ents)))
    for r in fc:
        got[(r["day"] - start).days, ents.index(r["entity"])] = r["flow"]
    assert np.array_equal(got, _numpy_lowrank(a, p, ar, 4))


def test_forecast_queries_complete_entities(spark):
    """Stations without trips still get a forecast (completion from the basis)."""
    t = "2024-01-20T08:00:00"
    trips = trips_df(spark, [(t, t, "A", "B", "L", "L")] * 3)
    st = spark.createDataFrame([(1, "A", "L", None, 1), (2, "B", "L", None, 2), (3, "C", "L", None, 3)],
                               schemas.STATIONS)
    inp = Inputs(trips, stations=st)
    ents = FC.model_entities(st, "station_name", FC.STATION_SERIES)
    basis = ents.select("model", "entity", F.lit(0).alias("factor"), F.lit(1.0).alias("weight"))
    coef = spark.createDataFrame([(m, 0, 1, 1.0) for m in FC.STATION_SERIES], schemas.AR_COEF)
    out = {r["station"]: (r["flow_in"], r["flow_out"])
           for r in FC.predict_stations_flow(inp, "2024-01-21", basis, coef).collect()}
    assert out == {"A": (1, 1), "B": (1, 1), "C": (1, 1)}   # 3 trips / 3 stations on one factor


def test_model_loop_matches_linear_fold(spark):
    """Scoring a fitted linear pipeline step by step equals the fold with
    its raw-feature weights (the two M3 paths agree)."""
    from metrolens.plans import fit as FIT
    rng = np.random.default_rng(11)
    d0 = dt.date(2024, 1, 1)
    days = 120
    flows = (50 + 10 * np.sin(np.arange(days) * 2 * np.pi / 7) + rng.normal(0, 2, days)).round().astype(int)
    t = []
    for i, f in enumerate(flows):
        day = (d0 + dt.timedelta(days=i)).isoformat()
        t += [(f"{day}T08:00:00", f"{day}T09:00:00", "A", "B", "L", "L")] * int(f)
    trips = trips_df(spark, t)
    cal = spark.createDataFrame([(d0 + dt.timedelta(days=i), int((d0 + dt.timedelta(days=i)).weekday() < 5))
                                 for i in range(days + 10)], schemas.WORKDAYS)
    inp = Inputs(trips, workdays=cal)
    end = d0 + dt.timedelta(days=days - 1)
    model = FIT.fit_total_model(inp, d0, end)
    start = end + dt.timedelta(days=1)
    loop = FC.predict_total_flow_model(inp, start, 5, model)
    fold = FC.predict_total_flow(inp, start, 5, FIT.total_coefficients(model))
    a, b = loop.collect(), fold.collect()
    assert [r["time"] for r in a] == [r["time"] for r in b]
    assert [r["is_workday"] for r in a] == [r["is_workday"] for r in b]
    assert max(abs(x["flow"] - y["flow"]) for x, y in zip(a, b)) <= 1   # float ties only
    gbt = FIT.fit_total_model(inp, d0, end, regressor="gbt")
    assert FC.predict_total_flow_model(inp, start, 3, gbt).count() == 3


def test_n_step_equals_chained_one_steps(spark):
    """Step 2 of a 2-step forecast = a 1-step forecast from the history with
    step 1's (clipped, rounded) forecast appended."""
    rng = np.random.default_rng(5)
    a, p, ents, panel, basis, d0 = _panel_and_basis(spark, rng, n_ent=8, k=2)
    coef = spark.createDataFrame([("m", f, lag, w) for f in range(2) for lag, w in {1: 0.7, 7: 0.3}.items()],
                                 schemas.AR_COEF)
    start = d0 + dt.timedelta(days=28)
    two = lowrank.low_rank_forecast(panel, basis, coef, start, n=2).collect()
    one = lowrank.low_rank_forecast(panel, basis, coef, start, n=1)
    step1 = one.select("model", "entity", "day", F.col("flow").cast("double").alias("flow"))
    again = lowrank.low_rank_forecast(panel.unionByName(step1), basis, coef,
                                      start + dt.timedelta(days=1), n=1).collect()
    by_day = {(r["entity"], r["day"]): r["flow"] for r in two}
    assert {(r["entity"], r["day"]): r["flow"] for r in one.collect()} == \
        {k: v for k, v in by_day.items() if k[1] == start}
    assert {(r["entity"], r["day"]): r["flow"] for r in again} == \
        {k: v for k, v in by_day.items() if k[1] == start + dt.timedelta(days=1)}


def test_fits_beat_mean_and_are_stable(spark):
    from metrolens.plans import fit as FIT
    d0 = dt.date(2024, 1, 1)
    days = 112
    weekly = [40, 42, 41, 43, 45, 20, 15]
    rows = []
    for i in range(days):
        day = (d0 + dt.timedelta(days=i)).isoformat()
        for s, base in (("A", 1.0), ("B", 0.5), ("C", 2.0)):
            n = int(round(base * weekly[i % 7]))
            rows += [(f"{day}T08:00:00", f"{day}T09:00:00", s, "A", "L", "L")] * n
    trips = trips_df(spark, rows)
    cal = spark.createDataFrame([(d0 + dt.timedelta(days=i), int(i % 7 < 5)) for i in range(days + 7)],
                                schemas.WORKDAYS)
    inp = Inputs(trips, workdays=cal)
    end = d0 + dt.timedelta(days=days - 1)
    coef = FIT.total_coefficients(FIT.fit_total_model(inp, d0, end))
    train = FIT.total_training_rows(inp, d0, end).collect()
    pred = [coef["intercept"] + sum(coef[f] * r[f] for f in series.FEATURES) for r in train]
    labels = [r["label"] for r in train]
    mean = sum(labels) / len(labels)
    mse = sum((p_ - y) ** 2 for p_, y in zip(pred, labels)) / len(labels)
    mse_mean = sum((mean - y) ** 2 for y in labels) / len(labels)
    assert mse < 0.1 * mse_mean
    # PCA basis and factor AR: shapes, and the same numbers when refitted
    st = spark.createDataFrame([(1, "A", "L", None, 1), (2, "B", "L", None, 2), (3, "C", "L", None, 3)],
                               schemas.STATIONS)
    panel = FC.station_panel(Inputs(trips, stations=st), end + dt.timedelta(days=1), window=days)
    ents = FC.model_entities(st, "station_name", {"station_in": None})
    b1 = FIT.fit_basis(panel.where(F.col("model") == "station_in"), ents, 2)
    b2 = FIT.fit_basis(panel.where(F.col("model") == "station_in"), ents, 2)
    assert b1.count() == 3 * 2
    # sums of doubles depend on the order in which tasks end
    assert [r["weight"] for r in sorted(b1.collect())] == pytest.approx([r["weight"] for r in sorted(b2.collect())], abs=1e-9)
    ar = FIT.fit_factor_ar(panel.where(F.col("model") == "station_in"), b1, window=14)
    assert ar.count() == 2 * 14 and ar.select("lag").distinct().count() == 14
