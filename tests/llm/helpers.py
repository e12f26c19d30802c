"""Brute-force versions and shared fixtures for the operator tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_df(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); an extra column clashes with internal names."""
    from pyspark.sql import functions as F
    full = [(r[0], r[1], *(r[2:4] if len(r) >= 4 else ("en", "s"))) for r in rows]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)
    for clash in ("node", "component", "digest", "signature", "bands", "key", "take", "score", "copies", "word", "n"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingle_set(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def groups(rows, n, percent):
    """doc_id -> smallest doc_id reachable over exact Jaccard links."""
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return {i: find(i) for i, _ in sets}
