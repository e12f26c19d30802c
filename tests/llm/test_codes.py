import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolens.llm import codes

VECTORS = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("part", "entry", "at", "code", "error", "_label", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over Python integers."""
    kept = [(i, [int(np.floor(x * 256)) for x in v], lab) for i, v, lab in rows]
    width = len(kept[0][1]) // parts
    order = sorted(zip(kept, rows), key=lambda k: (k[0][0] is None, k[0][0] or 0, k[1][1]))
    books = [[k[1][p * width:(p + 1) * width] for k, _ in order[:entries]] for p in range(parts)]

    def nearest(x, p):
        part = x[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = [[list(e) for e in b] for b in books]
        for p in range(parts):
            members = {}
            for _, x, _ in kept:
                members.setdefault(nearest(x, p)[1], []).append(x[p * width:(p + 1) * width])
            for j, xs in members.items():
                moved[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
        books = moved
    out, label = [], {}
    for i, x, lab in kept:
        best = [nearest(x, p) for p in range(parts)]
        error = sum(e for e, _ in best)
        label[lab] = label.get(lab, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, lab))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), c, e, label[lab]) for i, c, e, lab in out), digest


def run(spark, df):
    coded, books = codes.vector_codes(spark, df)
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()), codes.codebooks_digest(books), books


@pytest.mark.parametrize("n,d", [(150, 32), (40, 16), (1, 48)])
def test_against_plain_loops(spark, n, d):
    rng = random.Random(n)
    rows = [(i, [rng.choice([0.0, -0.001, 0.5, rng.gauss(0, 0.2)]) for _ in range(d)], rng.choice([1, 2, None])) for i in range(n)]
    if n > 100:
        rows += [(5, rows[9][1], 1), (5, rows[5][1], 2), (None, rows[3][1], None)] + [(1000, rows[7][1], 1)] * 3
    bad = [(-5, None, 1), (-4, [], 1), (-3, [0.0] * (d - 1) + [None], 1), (-2, [float("nan")] * d, 1), (-1, [float("-inf")] * d, 2)]
    rng.shuffle(rows)
    got, digest, _ = run(spark, frame(spark, rows + bad).repartition(5))
    assert (got, digest) == brute(rows)


def test_integers_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1e7, -3e6, 2.5]) for _ in range(16)], 1) for i in range(90)]
    got, digest, _ = run(spark, frame(spark, rows))
    assert (got, digest) == brute(rows)
    assert codes.integers(np.array([[1e300, -0.001, 2.0 ** 80]])).tolist() == [[int(1e300) * 256, -1, 2 ** 88]]


def test_empty_and_uneven(spark):
    got, _, books = run(spark, frame(spark, []).coalesce(1))
    assert got == [] and books.size == 0
    assert run(spark, frame(spark, [(1, None, 1), (2, [], 1)]))[0] == []
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, frame(spark, [(1, [1.0] * 17, 1)]))


def test_decoded_vectors_are_the_named_entries(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)], 1) for i in range(120)]
    coded, books = codes.vector_codes(spark, frame(spark, rows))
    given = {i: codes.integers(np.array([v]))[0] for i, v, _ in rows}
    for r in codes.decoded(coded, books).collect():
        assert int(((np.array(r["vector"]) * 256 - given[r["vec_id"]]) ** 2).sum()) == r["error"]
