"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.llm import (
    byte_bpe,
    chat_format,
    collocations,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    license_scan,
    line_templates,
    packing,
    quality_model,
    quality_rules,
    toxicity,
    warc_zip,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ledger = quality_rules.ledger(quality_rules.measured(_table(spark, folder, "documents")))
    return ledger.withColumn("base_failed", quality_rules.fails("base")).withColumn(
        "kept", ~F.col("base_failed") & ~quality_rules.fails("strict-1")
    )


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], turns.schema)
    read = chat_format.read_back(chat_format.formatted(turns.unionAll(added)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda s: s["in_loss"]), lambda s: chat_format.unescaped(s["piece"]))
    return read.withColumn("loss_text", F.array_join(learnt, "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.joined(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_byte_bpe(spark: SparkSession, folder: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    words = byte_bpe.vocabulary(byte_bpe.read_ranks(public_tokenizers.path(ranks)))
    ids = byte_bpe.encoded(_table(spark, folder, "documents"), words, public_tokenizers.PATTERN)
    return byte_bpe.digest(ids.withColumn("decoded", byte_bpe.decoder(words, spark)("ids")))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicated(_table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_templates.without_recurring_lines(_table(spark, folder, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zip.archived(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.licensed(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents")).drop("first_doc")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and callable(query)
}
