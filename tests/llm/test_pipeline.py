"""The pipeline on a small corpus, each stage against a brute-force version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrolens.llm import bpe, quality
from metrolens.session import scratch_path
from tests.llm.helpers import groups, lower, prose, words

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    passage, item = prose(rng, 70), " ".join(f"question{rng.randrange(900)}" for _ in range(20))
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(60, 140))
        if i % 6 == 0:
            text = text.replace(" ", "!! ").upper()
        rows.append([i, text])
    rows[31][1] = rows[1][1]                                                     # exact copy
    rows[37][1] = rows[7][1].replace(rows[7][1].split()[30], "changed", 1)       # near copy
    for i in (13, 43, 73):
        w = rows[i][1].split()
        rows[i][1] = " ".join(w[:20] + [passage] + w[20:])                       # shared passage
    rows[49][1] += "\n" + item.upper()                                           # benchmark leak
    rows += [[500, None], [501, ""], [None, prose(rng, 80)], [2, rows[2][1]]]
    path = scratch_path(spark, "tiny")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 > 0), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage, item


def test_stage_order_and_run(spark, corpus):
    path, rows, passage, item = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_dedup", "substring_dedup", "decontamination", "encoding"]
    docs, outputs = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        outputs.append(docs)
    assert all(o.columns == COLUMNS for o in outputs[:-1])
    got = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outputs]

    # 1: shouted documents go, the others stay
    junk = {i for i in range(120) if i % 6 == 0}
    assert not junk & set(got[0]) and set(range(120)) - junk <= set(got[0]) and None in got[0]

    # 2: the smallest doc_id of each group stays
    kept = [(i, t) for i, t in got[0].items()]
    label = groups([(i, t) for i, t in kept if i is not None], 5, 80)
    assert set(got[1]) == {i for i, c in label.items() if i == c} | {None}
    assert 31 not in got[1] and 37 not in got[1] and outputs[1].where("doc_id = 2").count() == 1

    # 3: the passage stays once, all else is untouched
    holders = [i for i, t in got[2].items() if passage in (t or "")]
    assert holders == [13]
    for i, t in got[1].items():
        if i in (43, 73):
            assert words(got[2][i]) == words(t.replace(passage, ""))
        else:
            assert got[2][i] == t

    # 4: the leak goes
    assert set(got[3]) == set(got[2]) - {49} and not any(item in lower(t) for t in got[3].values())

    # 5: ids as the library gives them
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.default_tokenizer())
    for r in outputs[4].collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)

    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, outputs[4].collect()))


def test_quality_stage_equals_scoring_by_hand(spark, corpus):
    path, rows, *_ = corpus
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, quality.training_labels(labels))
    import pyarrow as pa
    scores = quality.predict(model, quality.statistics(pa.array([t for _, t in rows], pa.string())))
    want = sorted(str(i) for (i, _), s in zip(rows, scores) if s >= quality.ACCEPT)
    got = corpus_pipeline.accept_quality(spark, docs, path).collect()
    assert sorted(str(r["doc_id"]) for r in got) == want and np.isfinite(scores).all()


def test_empty_tables(spark, corpus):
    path, *_ = corpus
    empty = scratch_path(spark, "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_texts_that_share_an_id_do_not_join_groups(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 80) for _ in range(3))
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(1, a), (2, b), (5, near), (5, b + " end"), (6, c), (6, c), (6, c.upper()), (6, ""), (6, None), (None, a), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, None) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_version", F.lit("clash")).withColumn("tags", F.create_map(F.lit("k"), "lang"))
    from metrolens.llm import minhash
    got = minhash.distinct_documents(spark, docs)
    assert got.columns == docs.columns
    kept = sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in got.collect())
    assert kept == sorted([("1", a), ("2", b), ("6", c), ("6", ""), ("6", "none"), ("None", a), ("7", "")])
