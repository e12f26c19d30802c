"""The training-data pipeline: documents -> accepted, distinct, encoded texts.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of documents (other columns are dropped); the last one returns the encoded corpus. SQL can't
express the classifier or the tokenizer, so there is no oracle for the whole;
the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrolens.llm import bpe, decontam, minhash, paragraphs, quality
from metrolens.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts."""
    scored = quality.quality_scores(spark, docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at Jaccard 0.8 or more on five-word shingles."""
    return minhash.distinct_documents(spark, docs.select(*COLUMNS), n=5, percent=80)


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that an earlier document keeps."""
    return paragraphs.without(docs.select(*COLUMNS), paragraphs.repeated_paragraphs(spark, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(spark, docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text they decode to."""
    return bpe.encode_decode(spark, docs, outputs=("n_tokens", "ids", "decoded"), keep=COLUMNS)


STAGES = [
    ("quality", accept_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_paragraphs),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
