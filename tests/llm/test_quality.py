import random

import numpy as np
import pyarrow as pa

from metrolens.llm import quality
from tests.llm.helpers import docs_df, prose


def walk(model, row):
    """One row through the trees, node by node."""
    margin = model["base"]
    for feature, value, leaf in zip(model["feature"], model["value"], model["leaf"]):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (row[feature[at]] > value[at])
        margin += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_traversal_and_fit():
    rng = np.random.default_rng(0)
    x = rng.random((800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x[:600], y[:600])
    p = quality.predict(model, x)
    assert np.allclose(p, [walk(model, r) for r in x])
    assert ((p[600:] > 0.5) == y[600:]).mean() > 0.95


def test_degenerate_fits():
    x = np.zeros((4, len(quality.FEATURES)), np.float32)
    assert (quality.predict(quality.fit_trees(x[:0], np.zeros(0)), x) == 0.5).all()
    one = quality.predict(quality.fit_trees(x, np.ones(4)), x)
    assert np.allclose(one, 5 / 6)


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array([None, "", " \n", "A b! | #\nA b! | #", "x" * 100_000]))
    assert got.shape == (5, len(quality.FEATURES)) and np.isfinite(got).all() and (got[:3, 0] == 0).all()
    f = dict(zip(quality.FEATURES, got[3]))
    assert f["shouts"] == f["pipes"] == 0.25 and f["dup_lines"] == 0.5 and f["symbols"] == 0.5 and f["upper"] == 0.5


def test_held_out_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(rng, rng.randint(30, 90))
        rows.append((i, text if good else text.replace(" ", "!! ").upper()))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (4, rows[4][1]), (None, "text")]
    label_df = spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(spark, docs_df(spark, rows), label_df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    none = docs_df(spark, rows).limit(0)
    assert quality.quality_scores(spark, none, label_df).count() == 0
    assert {r["score"] for r in quality.quality_scores(spark, docs_df(spark, rows), label_df.limit(0)).collect()} == {0.5}


def test_scores_do_not_see_other_columns(spark):
    model = quality.fit_trees(np.random.default_rng(0).random((50, len(quality.FEATURES))), np.arange(50) % 2.0)
    a = quality.score(spark, docs_df(spark, [(1, "some text", "en", "a")]), model, ("doc_id",)).first()["score"]
    b = quality.score(spark, docs_df(spark, [(2, "some text", None, "b")]), model, ("doc_id",)).first()["score"]
    assert a == b


def test_repeated_rows_do_not_swell_the_fit(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 20 + i)) for i in range(60)]
    docs = docs_df(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.fit(spark, docs, labels)
    again = quality.fit(spark, docs.union(docs).union(docs), labels.union(labels))
    assert once["base"] == again["base"]
    assert all(np.array_equal(once[k], again[k]) for k in ("feature", "value", "leaf"))
