import collections

import pytest

from metrolens.llm import rules
from tests.llm.helpers import docs_df, words

TEXTS = [None, "", "   \n\t", "a b c a b c", "x # y\nx # y\n\nx # y", "é è ü | <b>", "word\x0bword\x0cw\x85w",
         "one two three four five " * 30, "\n".join(["same line here"] * 5 + ["other"]), "a" * 5000]


def brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    wins = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_base_statistics(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a b")]
    got = rules.base_statistics(docs_df(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text)


@pytest.mark.parametrize("value", [0, 1, 127, 128, 129, 255, 256, 999, 12345, 10**9])
def test_bucket_is_narrow(spark, value):
    from pyspark.sql import functions as F
    got = spark.range(1).select(rules.bucket(F.lit(value)).alias("b")).first()["b"]
    assert got <= value < got + max(1, got / 64)


def test_adaptive_fences_keep_clean_and_drop_odd(spark):
    clean = " ".join(f"ordinary{i % 97} words" for i in range(60))
    rows = [(i, f"{clean} number{i}", "en", None) for i in range(80)] + [(100, "sym### " * 99 + clean, "en", None),
                                                                        (101, clean, None, None), (102, None, None, "z")]
    got = {r["doc_id"]: r for r in rules.quality_rules(spark, docs_df(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(80)) and not got[100]["kept"]
    assert got[102]["base_failed"] and not got[102]["kept"]


def test_sketches_merge(spark):
    rows = [(i, "word " * (50 + i), "en", f"s{i % 3}") for i in range(60)]
    df = rules.base_statistics(docs_df(spark, rows))
    a, b = df.where("source = 's0'"), df.where("source <> 's0'")
    parts = rules.sketch(a).union(rules.sketch(b)).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, rules.sketch(df).collect()))


def test_empty(spark):
    assert rules.quality_rules(spark, docs_df(spark, [(1, "a")]).limit(0)).count() == 0


def test_junk_does_not_excuse_itself(spark):
    clean = lambda i, n=60: " ".join(f"ordinary{(i * 7 + j) % 997} words{(i + j * j) % 883}" for j in range(n // 2))
    rows = [(i, clean(i), "en", "web") for i in range(300)]
    rows += [(1000 + i, clean(i), "en", "forum") for i in range(70)]
    rows += [(2000 + i, clean(i) + " ##" * (8 + i % 9), "en", "forum") for i in range(30)]          # 30 % of a source
    rows += [(3000 + i, clean(i) + " <>" * (10 + i % 9), "en", "code") for i in range(80)]          # usual in this source
    rows += [(4000, clean(3, 600) + "\nthe same footer line\nthe same footer line", "en", "web"),
             (4001, clean(4, 60) + " $5 & more", "en", "web"), (4002, "\n".join([clean(5, 30), clean(6, 30)] * 2), "en", "web"),
             (4003, "\n".join(f"{clean(i, 20)}" for i in [*range(60), *range(30)]), "en", "web")]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(spark, docs_df(spark, rows)).collect()}
    assert all(got[i] for i in (*range(300), *range(1000, 1070), *range(3000, 3080), 4000, 4001))
    assert not any(got[i] for i in range(2000, 2030)) and not got[4003]
