"""Substring dedup by paragraphs (operator 8).

Two kinds of repeats of at least ``MIN_WORDS`` words are looked for:

* Paragraphs: single long lines, and blocks of shorter lines that follow each
  other without a blank or a long line between them, as a wrapped paragraph
  does. Each distinct one gets a MinHash signature over its word shingles;
  bands tuned for high recall (``BANDS`` of ``ROWS``: a pair at similarity 0.8
  is missed with a probability of 0.13 %) make colliding ones meet, the exact
  Jaccard similarity verifies them, and components of verified links are the
  groups. Every paragraph of a group but the first is removed.
* Passages inside them, equal word by word. Anchors are chosen by
  content (the least shingle hash of every ``WINDOW`` consecutive places), so
  any two equal runs of ``MIN_WORDS`` words share an anchor; the ``RUN`` words
  from it on are the key that collides. Colliding runs are chained, compared
  word by word beyond their ends, and removed when the whole is long enough.

"First" is the smallest doc_id (then the smallest start), so a removed
paragraph always has a counterpart in an earlier document.

Words are lower-cased. Null and short texts have no paragraphs, rows without
doc_id are left alone, rows sharing a doc_id are told apart by their text and
are never matched with each other. Spans are byte offsets into the UTF-8 text.
Repeated rows, ties and empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrolens.llm.common import binary_column, binary_rows, map_arrow, narrowed, stored
from metrolens.llm.minhash import _list_array, near_groups, set_digest, superminhash
from metrolens.llm.text import Words, mix64, shingles

MIN_WORDS = 50
SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 10, 3
RUN, WINDOW = 25, 26               # RUN + WINDOW - 1 = MIN_WORDS
_FOLD = 2                          # bytes kept of each place of a signature


def _named(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")


def _line_words(part: pa.RecordBatch, min_words: int):
    """(words of the batch, starts, ends, word counts, line counts) of its
    paragraphs: long lines, and blocks of shorter ones."""
    w = Words(part.column("text"), lower=True)
    ends = np.flatnonzero(w.buf == 10)
    if not len(ends):
        return w, ends, ends, ends, ends
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    text = np.searchsorted(w.offsets, starts, "right") - 1
    apart = (n == 0) | (n >= min_words)               # blank and long lines stand alone
    new = np.concatenate([[True], apart[1:] | apart[:-1] | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(n)]]) - 1
    total = np.add.reduceat(n, first)
    long = total >= min_words
    first, last = first[long], last[long]
    return w, starts[first], ends[last], total[long], last - first + 1


def _lines_as_texts(w: Words, starts, ends) -> Words:
    return Words(pa.array([w.buf[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), lower=False)


def long_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph: place, digest of its shingle set, signature."""

    def run(part):
        w, starts, ends, n, lines = _line_words(part, min_words)
        h, offsets = shingles(_lines_as_texts(w, starts, ends), SHINGLE)
        signature = (mix64(superminhash(h, offsets, BANDS * ROWS)) & np.uint64(0xFFFF)).astype("<u2")
        text = np.searchsorted(w.offsets, starts, "right") - 1
        return {"take": text, "start": starts - w.offsets[text], "end": ends - w.offsets[text], "n_words": n, "n_lines": lines,
                "digest": set_digest(h, offsets), "signature": [s.tobytes() for s in signature]}

    return map_arrow(_named(docs), run, "start int, end int, n_words int, n_lines int, digest binary, signature binary",
                     keep=("doc_id", "version"))


def line_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the paragraphs at (doc_id, version, start, end) of ``wanted``."""
    wanted = stored(spark, wanted, "wanted-lines")
    places = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end", "node")).alias("places"))

    def run(part):
        w = Words(part.column("text"), lower=True)
        take, starts, ends, nodes = [], [], [], []
        for i, places in enumerate(part.column("places").to_pylist()):
            for place in places:
                take.append(i)
                starts.append(w.offsets[i] + place["start"])
                ends.append(w.offsets[i] + place["end"])
                nodes.append(place["node"])
        h, offsets = shingles(_lines_as_texts(w, starts, ends), SHINGLE)
        return {"take": take, "node": nodes, "shingles": _list_array(h, offsets)}

    holders = narrowed(docs, wanted.select("doc_id"), "doc_id")
    return map_arrow(_named(holders).join(places, ["doc_id", "version"]), run, "node long, shingles array<long>")


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs that repeat one of an earlier document."""
    lines = stored(spark, long_lines(docs, min_words), "lines")
    # One class per shingle set; its 64-bit name is that of one set only.
    named = lines.withColumn("node", F.xxhash64("digest"))
    classes = named.groupBy("node").agg(F.min(F.struct("digest", "doc_id", "version", "start", "end", "signature")).alias("c"))
    classes = stored(spark, classes.select("node", "c.*"), "line-classes")
    width = ROWS * _FOLD
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)])
    place = classes.select("node", "doc_id", "version", "start", "end")
    groups = near_groups(spark, classes.select("node", "signature", bands.alias("bands")),
                         lambda wanted: line_sets(spark, docs, place.join(wanted, "node")), PERCENT, slack=0.4)
    known = classes.select(F.col("node").alias("own"), F.col("digest").alias("own_digest"))
    grouped = (named.drop("signature").join(groups, "node", "left")
               .join(known, (F.col("node") == F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
               .withColumn("component", F.coalesce("component", "own")).where("component IS NOT NULL"))
    grouped = stored(spark, grouped.select("component", "doc_id", "version", "start", "end", "n_words", "n_lines"), "line-groups")
    first = stored(spark, grouped.groupBy("component").agg(
        F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("last")).where("last <> keep_doc_id"), "first-lines")
    return (grouped.join(first, "component").where("doc_id <> keep_doc_id")
            .select("doc_id", "version", "start", "end", "n_words", "keep_doc_id",
                    F.when(F.col("n_lines") > 1, "block").otherwise("line").alias("kind")))


def _rolled(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix64(out + h[at + k])
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors(w: Words, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """Word places that hold the least shingle hash of some ``window``
    consecutive places of one text, from where ``run`` words follow."""
    places = w.counts - run + 1
    out = []
    h = w.hashes
    if len(h) < run:
        return np.zeros(0, np.int64)
    g = _rolled(h, np.arange(len(h) - SHINGLE + 1), SHINGLE)
    for i in np.flatnonzero(places >= window):
        own = g[w.first[i]:w.first[i] + places[i]]
        least = _slide(own, window, np.minimum)
        pad = np.zeros(window - 1, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), window, np.maximum)
        at = np.flatnonzero(most == own)
        # In periodic text the same hash is least again and again: one in `window` will do.
        new = np.concatenate([[True], own[at[1:]] != own[at[:-1]]])
        start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step = (at - start) // window
        keep = new | np.concatenate([[True], step[1:] != step[:-1]])
        out.append(at[keep] + w.first[i])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def anchored_runs(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at): key of the RUN words from word ``at`` on."""

    def run(part):
        w = Words(part.column("text"), lower=True)
        at = anchors(w)
        text = w.text[at]
        return {"take": text, "key": _rolled(w.hashes, at, RUN).view(np.int64), "at": at - w.first[text]}

    return map_arrow(_named(docs), run, "key long, at int", keep=("doc_id",))


def _beside(w: Words, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> dict[str, np.ndarray]:
    """Of the runs from word ``a`` to before ``b``: folded hashes of RUN words
    before (nearest first) and after, how many of them there are, and the byte
    places where the run starts or ends when 0 to RUN of them are taken in."""
    k = np.arange(RUN)
    first, end = w.first[text], w.first[text + 1]
    last = max(len(w.hashes) - 1, 0)
    fold = (w.hashes >> np.uint64(32)).astype("<u4")
    at_before, at_after = a[:, None] - 1 - k, b[:, None] + k
    wide = np.arange(RUN + 1)
    starts = w.starts[np.maximum(a[:, None] - wide, 0)] - w.offsets[text][:, None]
    ends = w.ends[np.minimum(b[:, None] - 1 + wide, last)] - w.offsets[text][:, None]
    return {"before": fold[np.maximum(at_before, 0)], "after": fold[np.minimum(at_after, last)],
            "n_before": np.minimum(a - first, RUN), "n_after": np.minimum(end - b, RUN),
            "starts": starts.astype("<i4"), "ends": ends.astype("<i4")}


def _common(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows, ``n`` at most."""
    same = np.column_stack([x == y, np.zeros(len(x), bool)])
    return np.minimum(same.argmin(axis=1), n)


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of ``min_words`` words or more that an earlier document holds too."""
    runs = stored(spark, anchored_runs(docs), "runs")
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("last")) \
        .where("last <> keep_doc_id").select("key", "keep_doc_id")
    shared = stored(spark, shared, "shared-runs")
    hits = stored(spark, runs.join(shared, "key"), "run-hits")
    kept = stored(spark, hits.where("doc_id = keep_doc_id").groupBy("key").agg(F.min("at").alias("keep_at")), "kept-runs")
    pairs = hits.where("doc_id <> keep_doc_id").join(kept, "key")

    # Chain runs that continue each other in both documents.
    line = Window.partitionBy("doc_id", "keep_doc_id", "shift").orderBy("at")
    pairs = pairs.withColumn("shift", F.col("at") - F.col("keep_at"))
    fresh = F.coalesce(F.col("at") - F.lag("at").over(line) > RUN, F.lit(True)).cast("int")
    chained = pairs.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(line))
    chains = chained.groupBy("doc_id", "keep_doc_id", "shift", "chain").agg(
        F.min("at").alias("at"), (F.max("at") + RUN).alias("stop"), F.min_by("key", "at").alias("key"))
    chains = stored(spark, chains, "chains")

    # Every chain shows the words next to it. The document that keeps the passage shows each place where
    # chains start (kind 1) or stop (kind 2) once, however many documents share it.
    kept_ends = chains.select(F.col("keep_doc_id").alias("doc_id"), "key", (F.col("at") - F.col("shift")).alias("at"),
                              (F.col("stop") - F.col("shift")).alias("stop"))
    fixed = (F.col("doc_id").alias("keep_doc_id"), F.lit(0).alias("shift"))
    starts = kept_ends.select("doc_id", F.lit(1).alias("kind"), "key", "at", (F.col("at") + RUN).alias("stop"), *fixed)
    stops = kept_ends.select("doc_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("key"),
                             (F.col("stop") - RUN).alias("at"), "stop", *fixed)
    kept_places = stored(spark, starts.distinct().union(stops.distinct()), "kept-places")
    sides = chains.select("doc_id", F.lit(0).alias("kind"), "key", "at", "stop", "keep_doc_id", "shift").union(kept_places)
    places = sides.groupBy("doc_id").agg(
        F.collect_list(F.struct("kind", "key", "at", "stop", "keep_doc_id", "shift")).alias("places"))

    def show(part):
        w = Words(part.column("text"), lower=True)
        places = part.column("places")
        text = np.repeat(np.arange(w.texts), np.diff(places.offsets.to_numpy()))
        p = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(places.type.value_type, places.flatten().flatten())}
        fits = p["stop"] <= w.counts[text]
        a = w.first[text] + p["at"]
        keyed = fits & (p["kind"] != 2)
        fits[keyed] = _rolled(w.hashes, a[keyed], RUN).view(np.int64) == p["key"][keyed]  # else another text of the doc_id
        text, a = text[fits], a[fits]
        p = {k: v[fits] for k, v in p.items()}
        made = _beside(w, a, a + p["stop"] - p["at"], text)
        wide = {k: binary_column(made.pop(k)) for k in ("before", "after", "starts", "ends")}
        return wide | made | {"take": text, "kind": p["kind"], "keep_doc_id": p["keep_doc_id"], "key": p["key"],
                              "at": p["at"] - p["shift"], "stop": p["stop"] - p["shift"], "length": p["stop"] - p["at"]}

    holders = narrowed(docs, sides.select("doc_id"), "doc_id")
    shown = map_arrow(_named(holders).join(places, "doc_id"), show,
                      f"kind int, keep_doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, at int, stop int, "
                      "length int, before binary, after binary, n_before int, n_after int, starts binary, ends binary",
                      keep=("doc_id", "version"))
    shown = stored(spark, shown, "chain-sides")
    own = shown.where("kind = 0").drop("kind")

    def kept_side(kind: int, place: list[str], side: str) -> DataFrame:
        """Written, so that the joins read plain tables and a place that many documents share is split."""
        at = ["keep_doc_id", "kept_version", *place]
        return stored(spark, shown.where(F.col("kind") == kind).withColumnRenamed("version", "kept_version").select(
            *at, F.col(side).alias(f"kept_{side}"), F.col(f"n_{side}").alias(f"kept_n_{side}")).dropDuplicates(at), f"kept-{side}")

    both = (own.join(kept_side(1, ["key", "at"], "before"), ["keep_doc_id", "key", "at"])
            .join(kept_side(2, ["stop"], "after"), ["keep_doc_id", "kept_version", "stop"]))

    def extend(part):
        ints = lambda name, kind: binary_rows(part.column(name), 4).copy().view(kind)
        number = lambda name: part.column(name).to_numpy()
        grown = [_common(ints(side, "<u4"), ints(f"kept_{side}", "<u4"), np.minimum(number(f"n_{side}"), number(f"kept_n_{side}")))
                 for side in ("before", "after")]
        row = np.arange(part.num_rows)
        return {"start": ints("starts", "<i4")[row, grown[0]], "end": ints("ends", "<i4")[row, grown[1]],
                "n_words": number("length") + grown[0] + grown[1]}

    spans = map_arrow(both, extend, "start int, end int, n_words int",
                      keep=("doc_id", "version", "keep_doc_id"), sliced_by="starts")
    return spans.where(F.col("n_words") >= min_words).select(
        "doc_id", "version", "start", "end", "n_words", "keep_doc_id", F.lit("passage").alias("kind"))


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All spans to remove: doc_id, version (of its text), start, end, n_words,
    keep_doc_id (a document that keeps the paragraph) and kind."""
    if min_words < RUN + WINDOW - 1:
        raise ValueError(f"passages of fewer than {RUN + WINDOW - 1} words may have no anchor")
    return repeated_lines(spark, docs, min_words).union(repeated_passages(spark, docs, min_words)).distinct()


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of their texts; n_chars, where there is
    such a column, follows the new text."""
    cuts = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    keyed = docs.withColumn("version", F.xxhash64("text"))
    joined = keyed.join(cuts.withColumnRenamed("doc_id", "cut_id").withColumnRenamed("version", "cut_version"),
                        F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("version") == F.col("cut_version")), "left")

    def cut(part):
        out = []
        for text, cuts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("cuts").to_pylist()):
            if cuts:
                kept, at = [], 0
                for start, end in sorted((c["start"], c["end"]) for c in cuts):
                    kept.append(text[at:max(at, start)])
                    at = max(at, end)
                text = b"".join([*kept, text[at:]])
            out.append(None if text is None else text.decode())
        return {"new_text": out}

    others = tuple(c for c in docs.columns if c != "text")
    done = map_arrow(joined.select(*docs.columns, "cuts"), cut, "new_text string", keep=others)
    done = done.withColumnRenamed("new_text", "text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
