import random

import numpy as np

from pyspark.sql import functions as F

from metrolens.llm import langid
from metrolens.llm.common import id_bucket
from tests.llm.helpers import docs_df

SYLLABLES = {"en": ["the", "ing", "and", "th", "ou"], "de": ["sch", "ein", "ung", "ü", "der"], "fr": ["eau", "é", "que", "ç", "oi"]}


def corpus(n=240):
    rng = random.Random(1)
    text = lambda lang: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 40)))
    return [(i, text(lang).upper() if i % 9 == 0 else text(lang), lang, "s")
            for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(n))]


def test_held_out_accuracy_and_undetermined(spark):
    rows = corpus() + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !?", "de", "s"), (1003, "der einung", None, "s"),
                       (5, corpus()[5][1], "en", "s"), (None, "eauque é", "fr", "s")]
    held = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    got = langid.language_id(spark, docs_df(spark, rows), held).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in corpus()}
    out = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert out and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.98
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == "de" and by_id[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_sees_the_text_only(spark):
    rows = corpus(80)
    model = langid.fit(docs_df(spark, rows).select("doc_id", "text", "lang"))
    one = langid.identify(spark, docs_df(spark, [(7, "the thing and", "fr", "x")]), model).first()
    other = langid.identify(spark, docs_df(spark, [(8, "the thing and", None, None)]), model).first()
    assert (one["lang_pred"], one["score"]) == (other["lang_pred"], other["score"]) == ("en", one["score"])


def test_foreign_text_is_rejected(spark):
    model = langid.fit(docs_df(spark, corpus(120)).select("doc_id", "text", "lang"))
    got = langid.identify(spark, docs_df(spark, [(1, "жзщ бгд " * 30), (2, corpus(3)[1][1])]), model).collect()
    assert [r["rejected"] for r in sorted(got, key=lambda r: r["doc_id"])] == [True, False]


def test_no_training_rows_and_empty_table(spark):
    rows = docs_df(spark, [(1, "the thing", None, "s")])
    assert langid.language_id(spark, rows, F.lit(False)).first()["lang_pred"] == "und"
    assert langid.language_id(spark, rows.limit(0), F.lit(False)).count() == 0


def test_several_centroids_each_a_unit_vector():
    rng = np.random.default_rng(0)
    x = rng.random((40, langid.BUCKETS)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 4)
    assert c.shape[0] == 4 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)


def test_blocks_do_not_change_counts(monkeypatch):
    texts = [r[1] for r in corpus(20)] + [None, "x" * 50_000]
    whole = langid.gram_counts(texts)
    assert (np.vstack([langid.gram_counts([t]) for t in texts]) == whole).all()


def test_centroids_share_the_rows_among_them():
    rng = np.random.default_rng(1)
    topics = rng.random((3, 300))                                        # three kinds of text and a few odd ones
    x = np.zeros((300, langid.BUCKETS), np.float32)
    for i in range(300):
        x[i, (i % 3) * 300:(i % 3) * 300 + 300] = topics[i % 3] + 0.3 * rng.random(300)
    for i in (5, 90):
        x[i] = 0
        x[i, 2000 + i] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_kmeans(x, 4)
    label = np.argmax(x @ c.T, axis=1)
    size = np.bincount(label, minlength=len(c))
    assert len(c) >= 3 and size.min() >= langid.LEAST_SHARE * len(x)
    typical = [i for i in range(300) if i not in (5, 90)]
    assert all(len({i % 3 for i in typical if label[i] == k}) == 1 for k in range(len(c)))
    assert np.array_equal(c, langid.spherical_kmeans(x, 4))
    same = np.repeat(x[:1], 30, axis=0)
    assert len(langid.spherical_kmeans(same, 4)) == 1 and len(langid.spherical_kmeans(x[:1], 4)) == 1


def test_repeated_rows_do_not_swell_the_sample(spark):
    rows = [(i, f"text {i}", "en", "s") for i in range(400)] + [(9, "the same", "en", "s")] * 3000
    train = docs_df(spark, rows).select("doc_id", "text", "lang")
    got = [tuple(r) for r in langid.drawn(train, {"en": 401}, 100).collect()]
    assert len(got) == len(set(got)) and 50 < len(got) < 200
    assert len(set(langid.fit(train, per_language=100)["langs"])) == 1
