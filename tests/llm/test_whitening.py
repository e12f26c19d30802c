import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolens.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("i", "n", "total", "d", "deviation", "whitened"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("spectrum", ["random", "repeated", "close", "wide", "low rank", "diagonal"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components_are_the_eigenvectors(spectrum, n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    e = {"random": rng.uniform(1, 9, n), "repeated": np.repeat([5.0, 2.0], [n // 2, n - n // 2]),
         "close": 1 + 1e-6 * np.arange(n), "wide": 10.0 ** -np.arange(n, dtype=float).clip(max=9),
         "low rank": np.where(np.arange(n) < 3, 4.0 + np.arange(n), 0.0), "diagonal": np.arange(1.0, n + 1)}[spectrum]
    a = np.diag(e) if spectrum == "diagonal" else (q * e) @ q.T
    a = (a + a.T) / 2
    for k in {1, min(8, n), n}:
        values, vectors = whitening.components(a, k)
        want, basis = np.linalg.eigh(a)
        want, basis = want[::-1], basis[:, ::-1]
        scale = np.abs(want).max()
        assert np.abs(values - want[:k]).max() < 1e-13 * n * scale
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * n * scale
        for i in range(k):                                   # the space of eigenvalues within a gap
            near = np.abs(want - values[i]) < 1e-3 * scale
            assert np.linalg.norm(basis[:, near].T @ vectors[:, i]) > 1 - 1e-12


def test_polar_factor_is_the_sign_matrix():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    e, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (q * np.sign(e)) @ q.T).max() < 1e-12


def check(got, vectors, k=8):
    """``got``: rows of the query; ``vectors``: (vec_id, entries) of the usable rows."""
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 100_000
    n, d = x.shape
    s = x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = y @ q / np.sqrt(e)
    table = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9
        table.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert sorted(table) == list(range(1, min(k, d) + 1))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for c, rows in table.items():
        for sign in (1, -1):
            want = sorted(((i, dev, sign * z) for (i, _), dev, z in zip(vectors, deviation, w[:, c - 1])), key=key)
            have = sorted(rows, key=key)
            if np.abs(np.array([a[2] - b[2] for a, b in zip(have, want)])).max() < 1e-7:
                assert [a[:2] for a in have] == [b[:2] for b in want]
                break
        else:
            raise AssertionError(c)


def rows_of(spark, df):
    """The query's rows for a table given as a frame."""
    import uuid

    from metrolens.session import checkpoint_dir
    folder = f"{checkpoint_dir(spark)}/vec-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/embeddings.parquet")
    return queries.op12_qdwh_whitening(spark, folder).collect()


def test_query_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(5, vectors[5][1]), (None, vectors[9][1]), (301, [0.0] * 12)]
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [None] + [1.0] * 11), (904, [float("nan")] * 12),
           (905, [float("inf")] + [0.0] * 11), (906, [float("-inf")] + [0.0] * 11)]
    check(rows_of(spark, frame(spark, [(i, v, None if i and i % 3 else 1) for i, v in vectors + bad])), vectors)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(queries.op12_qdwh_whitening(spark, "/root/testdata/sf0.001").collect(),
          [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_empty_equal_and_far_vectors(spark):
    assert rows_of(spark, frame(spark, []).coalesce(1)) == []
    assert rows_of(spark, frame(spark, [(1, None, 1), (2, [], 1)])) == []
    assert rows_of(spark, frame(spark, [(i, [0.5, 0.25], 1) for i in range(5)])) == []          # nothing varies
    few = rows_of(spark, frame(spark, [(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1)]))                 # one component varies
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in few) == [(1, 1, 1.0), (2, 1, 1.0)]
    with pytest.raises(Exception, match="2\\^41"):
        rows_of(spark, frame(spark, [(1, [1e30], 1), (2, [1.0], 1)]))


def test_exact_deviations_beyond_64_bits():
    x = np.array([[2 ** 40, 5], [-(2 ** 40), 7]], np.int64)
    assert whitening._deviations(x, 10 ** 6, [3, 4]) == [sum((10 ** 6 * int(a) - s) ** 2 for a, s in zip(r, (3, 4))) for r in x]
