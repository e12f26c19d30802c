"""Quality rules with adaptive thresholds (operator 10).

Every text gets integer base statistics. Instead of fixed cutoffs, each
statistic is held against a fence that its own (lang, source) group sets: the
group's values go into a mergeable quantile sketch - counts of integers in
buckets of at most 1/64 relative width - and the fence lies a few spreads
beyond the median, the upper one bounded by the group's lower spread or its
language's, so that much junk does not excuse itself. A sketch is a plain table (group, metric, bucket, n), so
merging is a sum: partial sums are made before the shuffle, a hot group sends
one row per bucket and task, and a language's sketch is the sum of its
sources' sketches. Groups of fewer than ``min_rows`` rows use the sketch of
their language, and small languages that of the whole table.

Nulls: a null text counts as empty, null lang or source form their own group.
Texts without words fail the base rule. Repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrolens.llm.common import map_arrow, stored
from metrolens.llm.text import Words, mix64, span_hashes

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))

# (name, numerator, denominator, noise, least): statistics in thousandths. A text of n words
# (lines) may lie noise / sqrt(n) beyond the fence, ``least`` at any length: one symbol or one
# repeated line weighs much in a short text and says little about it.
METRICS = (
    ("symbol", "n_symbols", "n_words", 700, 5),
    ("dup_line", "n_dup_lines", "n_lines", 1000, 100),
    ("repeat", "n_repeat_words", "n_words", 4000, 150),
    ("word_len", "word_chars", "n_words", 14000, 300),
)
SPREADS = 4
MIN_ROWS = 50
_BITS = 7          # values below 128 are exact; above, 64 buckets for each power of two


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the integer statistics of each whole text."""

    def measure(part):
        w = Words(part.column("text"), lower=False)
        n = w.texts
        per_text = lambda flags, at: np.bincount(np.searchsorted(w.offsets, at, "right") - 1,
                                                 weights=flags, minlength=n).astype(np.int64)
        lead = (w.buf & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(lead)])
        chars = np.bincount(w.text, weights=points[w.ends] - points[w.starts], minlength=n).astype(np.int64)
        symbol = np.flatnonzero(np.isin(w.buf, np.frombuffer(SYMBOLS, np.uint8)))
        n_lines, n_dup = duplicate_lines(w)
        return {"n_words": w.counts, "word_chars": chars, "n_symbols": per_text(None, symbol),
                "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": repeated_words(w)}

    rows = docs.select("doc_id", "lang", "source", "text")
    return map_arrow(rows, measure, "n_words long, word_chars long, n_symbols long, n_lines long, "
                     "n_dup_lines long, n_repeat_words long", keep=("doc_id", "lang", "source"))


def duplicate_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier line."""
    ends = np.flatnonzero(w.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(w.offsets, starts, "right") - 1
    n_lines = np.bincount(text, minlength=w.texts)
    keyed = mix64(span_hashes(w.buf, starts, ends) ^ mix64(text.astype(np.uint64)))
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(text[first], minlength=w.texts)
    return n_lines, n_lines - distinct


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Per text: words covered by an ``n``-word window found twice or more."""
    size = max(len(w.hashes) - n + 1, 0)
    rolled = mix64(w.text[:size].astype(np.uint64))
    for k in range(n):
        rolled = mix64(rolled + w.hashes[k:k + size])
    inside = np.flatnonzero(w.text[:size] == w.text[n - 1:])
    order = inside[np.argsort(rolled[inside], kind="stable")]
    key = rolled[order]
    same = key[1:] == key[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
    at = order[twice]
    covered = np.zeros(len(w.hashes), bool)
    for k in range(n):
        covered[at + k] = True
    return np.bincount(w.text, weights=covered, minlength=w.texts).astype(np.int64)


def metric(numerator: str, denominator: str) -> Column:
    return F.expr(f"CASE WHEN {denominator} > 0 THEN 1000 * {numerator} DIV {denominator} ELSE 0 END")


def bucket(value: Column) -> Column:
    """The smallest integer of the value's bucket (values are not negative)."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(_BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over texts that have words."""
    values = F.array(*[F.struct(F.lit(name).alias("metric"), bucket(metric(a, b)).alias("bucket"))
                       for name, a, b, *_ in METRICS])
    return (stats.where("n_words > 0").select("lang", "source", F.explode(values).alias("v"))
            .groupBy("lang", "source", "v.metric", "v.bucket").agg(F.count(F.lit(1)).alias("n")))


def quantiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and metric: size and the 25, 50 and 75 % points of a sketch.
    A group has at most a few thousand buckets, whatever its number of rows."""
    run = Window.partitionBy(*keys, "metric").orderBy("bucket")
    whole = Window.partitionBy(*keys, "metric")
    ranked = merged.select("*", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("rows"))
    point = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), point(25).alias("q25"),
                                               point(50).alias("q50"), point(75).alias("q75"))


def thresholds(sketched: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): the lower and upper fence of each metric,
    taken from the finest level - source, language, all - with ``min_rows``."""
    by_lang = sketched.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    by_all = sketched.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    q1 = quantiles(sketched, ["lang", "source"]).alias("s")
    q2 = quantiles(by_lang, ["lang"]).alias("l")
    q3 = quantiles(by_all, []).alias("a")
    joined = (q1.join(q2, F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.metric") == F.col("l.metric")))
              .join(q3, F.col("s.metric") == F.col("a.metric")))
    level = lambda c: (F.when(F.col("s.rows") >= min_rows, F.col(f"s.{c}"))
                       .when(F.col("l.rows") >= min_rows, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")))
    up = lambda t: F.col(f"{t}.q75") - F.col(f"{t}.q50")
    mid, low = level("q50"), level("q50") - level("q25")
    # Junk lies on the upper side: above the median a group spreads no further than below it, or than its language does.
    wider = F.when(F.col("l.rows") >= min_rows, up("l")).otherwise(up("a"))
    high = F.least(level("q75") - mid, F.greatest(low, wider))
    fences = joined.select(
        F.col("s.lang").alias("lang"), F.col("s.source").alias("source"), F.col("s.metric").alias("metric"),
        (mid - SPREADS * low).alias("lo"), (mid + SPREADS * high).alias("hi"))
    pick = lambda c, name: F.max(F.when(F.col("metric") == name, F.col(c))).alias(f"{name}_{c}")
    return fences.groupBy("lang", "source").agg(*[pick(c, name) for name, *_ in METRICS for c in ("lo", "hi")])


def quality_rules(spark: SparkSession, docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Base statistics, base verdict, fences and the final verdict per row."""
    stats = stored(spark, base_statistics(docs), "rules-stats")
    fences = thresholds(sketch(stats), min_rows)
    inside = F.lit(True)
    for name, a, b, noise, least in METRICS:
        value = metric(a, b)
        beyond = F.greatest(value - F.col(f"{name}_hi"), F.col(f"{name}_lo") - value, F.lit(0)).cast("double")
        inside = inside & ((beyond <= least) | (beyond * beyond * F.col(b) <= noise * noise))
    s, t = stats.alias("s"), fences.alias("t")
    joined = s.join(t, F.col("s.lang").eqNullSafe(F.col("t.lang"))
                    & F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select("s.*", failed.alias("base_failed"),
                         (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))
