"""The catalogue queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import (
    chat, langid, merkle, minhash, mixing, oracles, packing, quality, runs, simhash, suffix, topk, toxicity, warc)
from canopy.llm.common import table
from canopy.sources.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the smallest id it is linked to at 3 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to dictionary-compressed archives, and what the archives hold."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch_dir(spark, "warc")
    warc.write_archives(pages, folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fifth = toxicity.remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs, labels, "toxic", fifth != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "score",
        toxicity.toxic(F.col("score")).cast("int").alias("predicted"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes, with its source's size and target."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as power-of-two pieces of at most 2048 ids."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.public_tokenizer(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best integer inner products of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    return chat.digests(chat.format_conversations(said.unionByName(extra)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    return quality.verdict(quality.measure(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
        "base_failed", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings that documents before it also have."""
    return suffix.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    fourth = toxicity.remainder(F.col("doc_id"), 4)
    model = langid.fit(docs, fourth != 2)
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(fourth == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, a tenth of the documents made periodic first."""
    return runs.run_digests(table(spark, sf_dir, "documents"), loop=True)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and the smallest id it is linked to at a similarity of 0.8."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof in the Merkle manifest, and what a claim of one more character folds to."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.verified_documents(table(spark, sf_dir, "documents"), tampered)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline, one after the other, over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_warc_archive, op3_toxicity, op4_mix_sources, op5_packing, op6_top_k, op7_chat_format,
        op8_quality_rules, op9_suffix_dedup, op10_language_id, op11_periodic_runs,
        op12_minhash_near_dedup, op13_merkle_manifest, pipeline)}

ORACLES: dict[str, str] = {
    "op2_warc_archive": oracles.warc_sql(),
    "op6_top_k": oracles.top_k_sql(),
    "op4_mix_sources": oracles.mix_sql(),
    "op7_chat_format": oracles.chat_sql(),
    "op8_quality_rules": oracles.quality_sql(),
    "op12_minhash_near_dedup": oracles.near_sql(),
    "op13_merkle_manifest": oracles.merkle_sql(),
}
