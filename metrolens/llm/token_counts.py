"""Token counts without ids (operator 9).

Pieces are counted once per distinct pre-token and joined to the pre-token
frequencies of each document; token ids are never kept. Pre-token frequencies
are steep, so the join is split: the most frequent pre-tokens - at most
``HOT_WORDS`` of them, a fixed bound - travel to the tasks with their piece
counts and are summed where the text is read; only the rare rest is shuffled
and joined by key. A very common pre-token therefore never makes a hot key.
Shuffled rows carry two independent hashes of a pre-token (96 bits) instead
of its text.

Null and empty texts have no tokens. Special strings inside a text count as
one token each, the library's default. Repeated rows give repeated results,
rows without doc_id are counted as well; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.bpe import Codec, default_tokenizer, read_tokenizer
from metrolens.llm.common import map_arrow, stored

HOT_WORDS = 400_000
_WORDS_PER_FLUSH = 500_000


def pre_token_counts(docs: DataFrame, spec) -> DataFrame:
    """(word, n): occurrences of each distinct pre-token over all texts,
    summed inside each task before the shuffle."""

    def flushed(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        codec, seen = Codec(spec.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(codec.plain_pieces(text or ""))
                if len(seen) >= _WORDS_PER_FLUSH:
                    yield flushed(seen)
                    seen.clear()
        yield flushed(seen)

    partial = docs.select("text").mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, spec) -> DataFrame:
    """Adds ``pieces``: the number of tokens of each distinct pre-token."""
    cell: list[Codec] = []

    def run(part):
        if not cell:
            cell.append(Codec(spec.value))
        return {"pieces": [len(cell[0].encode_word(w)) // 4 for w in part.column("word").to_pylist()]}

    return map_arrow(words, run, "pieces int", keep=("word", "n"), sliced_by="word")


def frequent(counted: DataFrame, most: int) -> dict[str, int]:
    """word -> pieces of the most frequent words, ``most`` at most: all words
    above the smallest frequency step (powers of two) that keeps the bound."""
    steps = counted.groupBy(F.length(F.bin("n")).alias("step")).agg(F.count(F.lit(1)).alias("words"))
    upto, least = 0, None
    for step, words in sorted(steps.collect(), reverse=True):      # at most 64 rows
        if upto + words > most:
            break
        upto, least = upto + words, step
    if least is None:
        return {}
    top = counted.where(F.length(F.bin("n")) >= least).select("word", "pieces").toPandas()
    return dict(zip(top["word"].tolist(), top["pieces"].tolist()))


def word_keys(word: Column) -> list[Column]:
    return [F.xxhash64(word).alias("w1"), F.hash(word).alias("w2")]


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None,
                 hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))
    counted = stored(spark, piece_counts(pre_token_counts(docs, spec), spec), "pre-tokens")
    hot = spark.sparkContext.broadcast(frequent(counted, hot_words))
    cell: list[Codec] = []
    rare_type = pa.list_(pa.field("element", pa.struct([("word", pa.string()), ("freq", pa.int32())])))

    def run(part):
        if not cell:
            cell.append(Codec(spec.value))
        codec, known = cell[0], hot.value
        n_bytes, hot_tokens, words, freqs, ends = [], [], [], [], [0]
        for text in part.column("text").to_pylist():
            text = text or ""
            seen = Counter(codec.plain_pieces(text))
            tokens = codec.count_special(text)
            for w, f in seen.items():
                n = known.get(w)
                if n is None:
                    words.append(w)
                    freqs.append(f)
                else:
                    tokens += n * f
            n_bytes.append(len(text.encode()))
            hot_tokens.append(tokens)
            ends.append(len(words))
        rare = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.StructArray.from_arrays(
            [pa.array(words, pa.string()), pa.array(freqs, pa.int32())], names=["word", "freq"]))
        return {"n_bytes": n_bytes, "hot_tokens": hot_tokens, "rare": rare.cast(rare_type)}

    # A row is known by its doc_id and a hash of its text: equal rows have equal sums.
    rows = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("k1"), F.hash("text").alias("k2"), "text")
    split = map_arrow(rows, run, "n_bytes long, hot_tokens long, rare array<struct<word:string,freq:int>>",
                      keep=("doc_id", "k1", "k2"))
    each = split.select("doc_id", "k1", "k2", "n_bytes", "hot_tokens", F.posexplode_outer("rare").alias("pos", "r"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    w1, w2 = word_keys(F.col("r.word"))
    each = each.select(
        "k1", "k2", *[F.when(head, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "hot_tokens")],
        head.cast("int").alias("copies"), F.coalesce("r.freq", F.lit(0)).alias("freq"),
        F.when(F.col("r").isNull(), F.col("k1")).otherwise(w1).alias("w1"),      # spread rows without rare words
        F.when(F.col("r").isNull(), F.col("k2")).otherwise(w2).alias("w2"))
    known = counted.select(*word_keys(F.col("word")), "pieces")
    summed = (each.join(known, ["w1", "w2"], "left").groupBy("k1", "k2").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("hot_tokens").alias("hot_tokens"),
        F.sum("copies").alias("copies"), F.sum(F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("tokens")))
    return (summed.select("doc_id", "n_bytes", F.expr("hot_tokens + tokens DIV copies").alias("n_tokens"),
                          F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy")).drop("copy"))
