"""The registered queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprints, html_extraction, interaction, language_id, licenses, media, mixing, ngram_join, oracle, packing, quality, sharding, token_files
from .common import stored, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    placed = sharding.assign(stored(rows, "sharding"))  # texts are read once
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.planned(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extraction.extract_pages(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare(fingerprints.edited(fingerprints.with_next(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(token_files.write_files(table(spark, sf_dir, "documents")), "token-files")
    return token_files.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, (85, 100)).select("doc_id", "n_shingles", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.described(media.restore(*media.store(table(spark, sf_dir, "documents"))))
    payload = F.col("payload")
    tail = F.substring(payload, -64, 64)
    return rows.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_sha256", "license_id", F.array_join("notices", " ").alias("notices"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, policy = quality.ledger(table(spark, sf_dir, "documents")), quality.PRODUCTION
    base = quality.Policy("base", 1, quality.BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(base).alias("base_failed"), (~quality.fails(policy)).alias("kept"), "failed")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.marks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_fingerprints": op5_fingerprints,
    "op6_token_files": op6_token_files,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": oracle.COLLOCATIONS,
    "op12_quality_rules": oracle.QUALITY_RULES,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}
