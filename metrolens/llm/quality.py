"""Quality classifier: histogram gradient-boosted trees (operator 4).

Every text is described by document statistics alone. The trees are grown on
quantile histograms of these statistics, one level at a time, with logistic
loss, and stored as flat arrays (a complete binary tree each), so that a batch
of texts walks all trees at once in numpy.

The fit uses a bounded sample of labelled rows, ``FIT_ROWS`` at most on
average, chosen by a hash of doc_id; scoring reads every whole text.

Null and empty texts are scored like any other (all statistics 0). Labels
without doc_id or quality are ignored; without any label all scores are 0.5,
with one class only the score is its smoothed share. Repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import id_bucket, map_arrow
from metrolens.llm.rules import SYMBOLS, duplicate_lines, repeated_words
from metrolens.llm.text import Words, mix64

FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 1.0
ACCEPT = 0.3
FEATURES = ("log_words", "word_len", "symbols", "pipes", "shouts", "stops", "commas", "upper", "digits",
            "non_ascii", "spaces", "dup_lines", "repeats", "distinct", "top_word", "line_words")


def statistics(column) -> np.ndarray:
    """(texts, FEATURES) of a batch of texts."""
    w = Words(column, lower=False)
    n = w.texts
    owner_of = lambda at: np.searchsorted(w.offsets, at, "right") - 1
    count = lambda mask: np.bincount(owner_of(np.flatnonzero(mask)), minlength=n).astype(float)
    words, chars = w.counts.astype(float), np.diff(w.offsets) - 1.0
    per_word = lambda v: v / np.maximum(words, 1)
    per_char = lambda v: v / np.maximum(chars, 1)
    buf = w.buf
    upper, lower = count((buf >= 65) & (buf <= 90)), count((buf >= 97) & (buf <= 122))
    n_lines, n_dup = duplicate_lines(w)
    # distinct words and the most frequent word of each text
    keyed = np.sort(mix64(w.hashes ^ mix64(w.text.astype(np.uint64))))
    order = np.argsort(mix64(w.hashes ^ mix64(w.text.astype(np.uint64))), kind="stable")
    new = np.concatenate([[True], keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(keyed)))
    text = w.text[order][at]
    distinct = np.bincount(text, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, text, runs)
    columns = {
        "log_words": np.log1p(words), "word_len": per_word(np.bincount(w.text, weights=w.ends - w.starts, minlength=n)),
        "symbols": per_word(count(np.isin(buf, np.frombuffer(SYMBOLS, np.uint8)))), "pipes": per_word(count(buf == 124)),
        "shouts": per_word(count(buf == 33)), "stops": per_word(count(buf == 46)), "commas": per_word(count(buf == 44)),
        "upper": upper / np.maximum(upper + lower, 1), "digits": per_char(count((buf >= 48) & (buf <= 57))),
        "non_ascii": per_char(count(buf >= 128)), "spaces": per_char(count(buf == 32)),
        "dup_lines": n_dup / np.maximum(n_lines, 1), "repeats": per_word(repeated_words(w)),
        "distinct": per_word(distinct), "top_word": per_word(top), "line_words": words / np.maximum(n_lines, 1),
    }
    return np.column_stack([columns[f] for f in FEATURES]).astype(np.float32)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Flat arrays: split feature and value of each inner node, value of each
    leaf; rows go right when above the value. Unsplit nodes send all left."""
    if not len(y):
        return {"base": 0.0, "feature": np.zeros((0, 1), int), "value": np.zeros((0, 1)), "leaf": np.zeros((0, 2))}
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(share / (1 - share))), "feature": [], "value": [], "leaf": []}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    n, features = binned.shape
    offset = np.arange(features) * BINS
    margin = np.full(n, model["base"])
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, int)
        split_f, split_v = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node * features * BINS)[:, None] + offset + binned).ravel()
            size = width * features * BINS
            sums = [np.bincount(cell, weights=np.repeat(v, features), minlength=size)
                    .reshape(width, features, BINS).cumsum(axis=2) for v in (g, h)]
            total = [s[:, :, -1:] for s in sums]
            score = lambda a, b: a * a / (b + L2)
            gain = score(*sums) + score(total[0] - sums[0], total[1] - sums[1]) - score(*total)
            gain[(sums[1] < LEAST_WEIGHT) | (total[1] - sums[1] < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            for i in range(width):
                if gain[i, f[i], b[i]] > 1e-6 and b[i] < len(edges[f[i]]):
                    split_f[first + i], split_v[first + i] = f[i], edges[f[i]][b[i]]
                else:
                    b[i] = BINS
            node = node * 2 + (binned[np.arange(n), f[node]] > b[node])
        gs, hs = (np.bincount(node, weights=v, minlength=2**depth) for v in (g, h))
        leaf = -RATE * gs / (hs + L2)
        margin += leaf[node]
        model["feature"].append(split_f)
        model["value"].append(split_v)
        model["leaf"].append(leaf)
    empty = (np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    return {"base": model["base"]} | {k: np.array(model[k]) if model[k] else e
                                      for k, e in zip(("feature", "value", "leaf"), empty)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities; every row walks every tree, one level a step."""
    feature, value, leaf = model["feature"], model["value"], model["leaf"]
    margin = np.full(len(x), model["base"])
    tree = np.arange(len(feature))
    at = np.zeros((len(x), len(feature)), int)
    while len(tree) and at.size and at.flat[0] < feature.shape[1]:
        right = np.take_along_axis(x, feature[tree, at], axis=1) > value[tree, at]
        at = 2 * at + 1 + right
    if len(tree):
        margin = margin + leaf[tree, at - feature.shape[1]].sum(axis=1)
    return 1 / (1 + np.exp(-margin))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Train on labels (doc_id, quality); at most about ``rows`` of them, so the
    broadcast of the chosen labels is bounded. Repeated rows of either table
    count once, and of texts that share a doc_id one is taken (the one with the
    least statistics), so that a repeated document does not swell the sample."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").distinct()
    share = min(1_000_000, int(1_000_000 * rows / max(known.count(), 1)) + 1)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows_ = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    described = map_arrow(rows_, lambda part: {"x": list(statistics(part.column("text")))},
                          "x array<float>", keep=("doc_id", "quality")) \
        .groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    if not len(described):
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(described["x"].to_numpy()), (described["quality"].to_numpy() > 0).astype(float)
    order = np.lexsort((y, *x.T))          # the rows' order in the collected table does not matter
    return fit_trees(x[order], y[order])


def score(spark: SparkSession, docs: DataFrame, model: dict, keep: tuple[str, ...]) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])),
                     lambda part: {"score": predict(shared.value, statistics(part.column("text")))},
                     "score double", keep=keep)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(id_bucket("doc_id", 5) != 0)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame,
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, score and predicted of every row."""
    scored = score(spark, docs, fit(spark, docs, training_labels(labels)), keep)
    return scored.withColumn("held_out", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))) \
        .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
