"""Language identification by nearest centroid (operator 3).

A text becomes a normalised TF-IDF vector of hashed character n-grams (one to
three bytes of its lower-case letters, words marked off by one space). Each
language has several centroids, found by spherical k-means over its training
vectors; a text takes the language of the centroid with the largest cosine.
It is rejected when that cosine is far below what the centroid's own training
texts reach.

Document frequencies count every training row. The centroids are fitted on a
bounded sample: ``PER_LANGUAGE`` rows of each language, ``SAMPLE_ROWS`` in all,
chosen by a hash. The prediction sees nothing but the text.

A null text, or one without a letter, is ``und`` with score 0 and rejected;
without any training row every text is. Long texts are used whole. Repeated
rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import map_arrow
from metrolens.llm.text import buffer_of

BUCKETS = 4096
CENTROIDS = 4
PER_LANGUAGE, SAMPLE_ROWS = 500, 20_000
LEAST_SHARE = 0.05     # of a language's rows in each of its clusters
REJECT = 0.5           # of the least cosine of a centroid's training texts
UNKNOWN = "und"
_ROWS = 256            # texts whose dense vectors are held at once
_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of hashed byte n-grams, n = 1, 2, 3."""
    raw = pa.array([(t or "").lower() for t in texts], pa.string())
    buf, offsets = buffer_of(raw)
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    keep = letter | np.concatenate([[False], letter[:-1]])       # a run of other bytes leaves one space
    at = np.flatnonzero(keep)
    owner = np.searchsorted(offsets, at, "right") - 1
    b = np.where(letter[at], buf[at], 32).astype(np.uint32)
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        code = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + b[k:len(b) - n + 1 + k]
        inside = owner[:len(code)] == owner[n - 1:]
        if n == 1:
            inside &= b != 32
        cell = (code * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(owner[:len(code)][inside] * BUCKETS + cell[inside], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def blocks(texts: list):
    for i in range(0, len(texts), _ROWS):
        yield texts[i:i + _ROWS]


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Training rows that hold each bucket; one partial sum per task."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in blocks(batch.column(0).to_pylist()):
                total += (gram_counts(texts) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "df"])

    out = np.zeros(BUCKETS)
    summed = train.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    for bucket, df in summed.collect():         # BUCKETS rows
        out[bucket] = df
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, share: float = LEAST_SHARE) -> np.ndarray:
    """Unit centroids of clusters that hold ``share`` of the rows or more. The
    start is drawn from the rows, likelier where they are far from the centres
    drawn so far, with a fixed seed: the result depends on the rows alone. A
    cluster that gets too small starts anew from a typical row of the largest
    one; what is too small in the end is left out and its rows fall to others."""
    k = min(k, len(x))
    draw = np.random.default_rng(len(x))
    c = x[[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(c) < k:
        far = np.maximum(1 - (x @ c.T).max(axis=1), 0).astype(np.float64)
        if far.sum() <= 1e-6 * len(x):               # all rows are alike
            break
        c = np.vstack([c, x[draw.choice(len(x), p=far / far.sum())]])
    for turn in range(rounds):
        cosine = x @ c.T
        label = np.argmax(cosine, axis=1)
        size = np.bincount(label, minlength=len(c))
        largest = int(size.argmax())
        for i in range(len(c)):
            if size[i] < share * len(x) and turn < rounds // 2:
                mine = np.flatnonzero(label == largest)
                c[i] = x[mine[np.argsort(cosine[mine, largest], kind="stable")[len(mine) * (i + 1) // (len(c) + 1)]]]
            elif size[i]:
                mean = x[label == i].mean(axis=0)
                c[i] = mean / max(np.linalg.norm(mean), 1e-12)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[size >= min(share * len(x), size.max())]


def drawn(train: DataFrame, sizes: dict[str, int], quota: int) -> DataFrame:
    """About ``quota`` distinct rows of each language, chosen by a hash; ``sizes``
    are the languages' numbers of distinct rows."""
    million = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(1_000_000 * quota / max(n, 1)) + 1)])
    return train.where(million < share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from ``train`` (doc_id, text, lang), rows with text and lang only."""
    train = train.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    distinct = F.approx_count_distinct(F.xxhash64("text", "doc_id"), 0.02)
    counted = train.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), distinct.alias("distinct")).collect()  # one row per language
    sizes = {r["lang"]: r["distinct"] for r in counted}
    if not sizes:
        return {"langs": [], "centroids": np.zeros((0, BUCKETS), np.float32), "least": np.zeros(0), "idf": np.ones(BUCKETS)}
    frequency = document_frequencies(train)
    idf = (np.log((1 + sum(r["rows"] for r in counted)) / (1 + frequency)) + 1).astype(np.float32)
    quota = min(per_language, max(1, sample_rows // len(sizes)))

    def run(part):
        rows = [v for texts in blocks(part.column("text").to_pylist())
                for v in vectors(gram_counts(texts), idf).astype(np.float16)]
        return {"vector": [r.tobytes() for r in rows]}

    sample = map_arrow(drawn(train, sizes, quota), run, "vector binary", keep=("lang",)).collect()
    langs, centres, least = [], [], []
    for lang in sorted(sizes):
        packed = sorted(r["vector"] for r in sample if r["lang"] == lang)
        if not packed:
            continue
        x = np.frombuffer(b"".join(packed), np.float16).astype(np.float32).reshape(-1, BUCKETS)
        c = spherical_kmeans(x, CENTROIDS)
        cosine = x @ c.T
        for i in range(len(c)):
            mine = cosine[np.argmax(cosine, axis=1) == i, i]
            langs.append(lang)
            centres.append(c[i])
            least.append(REJECT * float(mine.min()) if len(mine) else 0.0)
    return {"langs": langs, "centroids": np.array(centres, np.float32), "least": np.array(least), "idf": idf}


def identify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text, ...) with lang_pred, score (cosine, 0 to 1) and rejected."""
    shared = spark.sparkContext.broadcast(model)

    def run(part):
        m = shared.value
        langs, scores, rejected = [], [], []
        for texts in blocks(part.column("text").to_pylist()):
            if not m["langs"]:
                cosine = np.zeros((len(texts), 1))
            else:
                cosine = vectors(gram_counts(texts), m["idf"]) @ m["centroids"].T
            best = np.argmax(cosine, axis=1)
            for i, text in enumerate(texts):
                if not m["langs"] or text is None or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                else:
                    score = float(min(max(cosine[i, best[i]], 0.0), 1.0))
                    langs.append(m["langs"][best[i]])
                    scores.append(score)
                    rejected.append(score < m["least"][best[i]])
        return {"lang_pred": langs, "score": scores, "rejected": rejected}

    return map_arrow(docs, run, "lang_pred string, score double, rejected boolean",
                     keep=tuple(c for c in docs.columns if c != "text"))


def language_id(spark: SparkSession, docs: DataFrame, held_out: Column) -> DataFrame:
    """Fit on the rows that are not held out, predict all rows."""
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(rows.where("NOT coalesce(held_out, false)"))
    return identify(spark, rows.select("doc_id", "text", "held_out"), model)
