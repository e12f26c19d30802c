"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm import (bpe, chat, codes, decontam, langid, licenses, minhash, paragraphs, quality, rules, token_counts,
                           warc, whitening)
from metrolens.llm.common import id_bucket, stored, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, table(spark, sf_dir, "documents"))


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), n=3, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    return langid.language_id(spark, table(spark, sf_dir, "documents"), held_out)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda name: F.col("metadata.fields")[name].cast("long")
    captures = stored(spark, warc.round_trip(spark, table(spark, sf_dir, "pages"), payload=False), "captures")
    return warc.with_origins(captures, number("page-id")).select(
        number("page-id").alias("page_id"),
        F.coalesce("response.payload_length", number("payload-length")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.col("origin").alias("refers_to"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spark, table(spark, sf_dir, "documents"),
                             outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_doc_id", "kind", "start", "end", "n_words")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(spark, table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(spark, given.union(extra))
    return chat.read_back(formatted, in_order=True).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened, fit = whitening.whitening(spark, table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(x)) for x in fit["explained"]]).cast("array<double>")
    return whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit["n"]).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, "at").alias("explained"),
        F.lit(fit["identity_error"]).alias("identity_error"))


def op13_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.vector_codes(spark, table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_superminhash_dedup": op2_superminhash_dedup,
        "op3_language_id": op3_language_id,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_warc_transactions": op6_warc_transactions,
        "op7_bpe_encode_decode": op7_bpe_encode_decode,
        "op8_paragraph_dedup": op8_paragraph_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_quality_rules": op10_quality_rules,
        "op11_chat_trees": op11_chat_trees,
        "op12_qdwh_whitening": op12_qdwh_whitening,
        "op13_dictionary_codes": op13_dictionary_codes,
    }
