"""The registered queries of the operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm import decontam, fim, fingerprint, interpolation, langid, licenses, linededup, neardup, perspectives, pieces, quality, sharding, spelling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_longest_processing_time_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_exact", "n_near", F.char_length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op5_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text")), decoded=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op1_latent_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "kind", *(F.round(c, 6).alias(c) for c in ("cosine", "coverage", "answer")))


def op2_deleted_interpolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(_table(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digest(perspectives.rotate(_table(spark, sf_dir, "conversations")))


def op10_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(_table(spark, sf_dir, "documents"))


def op11_subword_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.arrange(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_anagram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(spelling.count_words(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_semantic_decontamination": op1_latent_semantic_decontamination,
    "op2_deleted_interpolation_scores": op2_deleted_interpolation_scores,
    "op3_longest_processing_time_shards": op3_longest_processing_time_shards,
    "op4_deletion_neighbourhood_lines": op4_deletion_neighbourhood_lines,
    "op5_patience_license_scan": op5_patience_license_scan,
    "op6_multiset_fingerprints": op6_multiset_fingerprints,
    "op7_sentencepiece_round_trip": op7_sentencepiece_round_trip,
    "op8_language_id": op8_language_id,
    "op9_perspective_rotation": op9_perspective_rotation,
    "op10_minhash_odd_sketches": op10_minhash_odd_sketches,
    "op11_subword_quality_scores": op11_subword_quality_scores,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_anagram_spelling_variants": op13_anagram_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op4_deletion_neighbourhood_lines": linededup.SQL,
    "op9_perspective_rotation": perspectives.DIGEST_SQL,
    "op10_minhash_odd_sketches": neardup.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_anagram_spelling_variants": spelling.SQL,
}
