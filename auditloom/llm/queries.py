"""One query per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import (licenses, maxent, mixing, multiset, packing, quality, secrets_scan, sharding,
                           simhash, spelling, substrings, topk, trie)
from auditloom.llm.words import table, text_batches

SHARDS = 16


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    dealt = sharding.assign_shards(rows, SHARDS)
    slotted = sharding.number_slots(dealt, ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                          F.col("slot").cast("long"), sharding.shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text_batches(spark)
    triples = secrets_scan.learnt_triples(docs)
    rows = docs.select("doc_id", secrets_scan.secret_spans(F.col("text"), triples=triples).alias("found"))
    spans = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "before", "block", "slot")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op6_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    def trimmed(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer(), keep=trimmed)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_model_scores(table(spark, sf_dir, "documents"))


def op11_multiset_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset.compare_next(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", multiset.in_hex(F.col("print")).alias("fingerprint"),
                       multiset.in_hex(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelling.variants(table(spark, sf_dir, "documents"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_shards": op1_jump_shards,
    "op2_secret_spans": op2_secret_spans,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_exact_topk": op4_exact_topk,
    "op5_license_digests": op5_license_digests,
    "op6_anchor_dedup": op6_anchor_dedup,
    "op7_simhash": op7_simhash,
    "op8_pack": op8_pack,
    "op9_quality": op9_quality,
    "op10_maxent": op10_maxent,
    "op11_multiset_print": op11_multiset_print,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
