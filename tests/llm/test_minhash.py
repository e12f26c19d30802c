import random

import numpy as np
import pyarrow as pa
import pytest

from metrolens.llm import minhash
from metrolens.llm.components import components
from metrolens.llm.text import Words, shingles
from tests.llm.helpers import docs_df, groups, prose, shingle_set


def sequential(hashes, places):
    """The signature one shingle at a time, without early stopping."""
    from metrolens.llm.text import mix64
    out = np.full(places, 2**64 - 1, np.uint64)
    for h in hashes:
        order = list(range(places))
        for j in range(places):
            draw = int(mix64(np.array([h], np.uint64) + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))[0])
            k = j + ((draw >> 32) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(int(out[order[j]]), (j << 32) | (draw & 0xFFFFFFFF))
    return out


def test_signature_equals_sequential_version():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 10, 80)] + [""]
    h, offsets = shingles(Words(pa.array([t.encode() for t in texts]), lower=True), 3)
    got = minhash.superminhash(h, offsets, 20)
    for i in range(len(texts)):
        assert (got[i] == sequential(h[offsets[i]:offsets[i + 1]], 20)).all()


def test_long_set_in_pieces(monkeypatch):
    h = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = minhash.superminhash(h, np.array([0, 5000]))
    monkeypatch.setattr(minhash, "_CHUNK", 700)
    assert (minhash.superminhash(h, np.array([0, 5000])) == whole).all()


def test_shingle_counts():
    texts = ["", "  ", "One", "one TWO", "a b c", "a b c a b c", "É é É", None]
    h, offsets = shingles(Words(pa.array(texts), lower=True), 3)
    assert list(np.diff(offsets)) == [len(shingle_set(t, 3)) for t in texts]


def fixture():
    rng = random.Random(7)
    rows, base = [], [prose(rng, n) for n in (1, 2, 5, 30, 60, 120, 400)]
    for i in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    # a chain: each step is similar, the ends are not
    w = prose(rng, 200).split()
    for i in range(12):
        w = w[4:] + prose(rng, 4).split()
        rows.append((300 + i, " ".join(w)))
    return rows + [(400, None), (401, ""), (402, " \n"), (403, rows[0][1].upper()), (0, rows[0][1])]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, n, percent):
    rows = fixture()
    got = minhash.near_duplicates(spark, docs_df(spark, rows), n, percent).collect()
    want = groups(list(dict(rows).items()), n, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(shingle_set(dict(rows)[r["doc_id"]], n)))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("shingles", [minhash.SET_SHINGLES, 200])
def test_buckets_with_several_groups_are_completed(spark, monkeypatch, shingles):
    """Wide buckets (one row per band) whose head is similar to few members,
    compared in one block of sets or in many."""
    monkeypatch.setattr(minhash, "SET_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "band_plan", lambda percent: (100, 1))
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = fixture()
    got = minhash.near_duplicates(spark, docs_df(spark, rows), 3, 85).collect()
    want = groups(list(dict(rows).items()), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (3, b), (5, b), (9, a), (None, a), (None, None)]
    got = minhash.near_duplicates(spark, docs_df(spark, rows), 3, 85).collect()
    assert {r["component_id"] for r in got if r["doc_id"] is not None} == {3}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = minhash.distinct_documents(spark, docs_df(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted(
        [("3", b), ("5", a), ("None", a), ("None", "None")])        # the text a is not lost by the id it shares with b


def test_empty(spark):
    assert minhash.near_duplicates(spark, docs_df(spark, [(1, "a")]).limit(0)).count() == 0


def test_band_plan_misses_little():
    for percent in (80, 85):
        bands, rows = minhash.band_plan(percent)
        assert bands * rows <= minhash.PLACES and (1 - (percent / 100) ** rows) ** bands < 1e-5


@pytest.mark.parametrize("per_task", [250_000, 10])
def test_components(spark, monkeypatch, per_task):
    import metrolens.llm.components as module
    monkeypatch.setattr(module, "LINKS_PER_TASK", per_task)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (100, 200)]
    links += [(1000, x) for x in range(1001, 1100)] + [(-5, 2000)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "a long, b long").repartition(6)).collect()))
    want = {i: 0 for i in range(1, 41)} | {200: 100, 300: 100} | {x: 1000 for x in range(1001, 1100)} | {2000: -5}
    assert got == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
