"""Registered queries of the training-data operators, and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import (bpe, conversation_trie, decontaminate, gru_lm, html_wrappers, license_scan, line_crf,
                          quality_rules, simhash_dedup, substring_dedup, vector_codes, warc, wavelet)
from logweave.llm.common import read, written


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules.judge(read(spark, sf_dir, "documents"), trusted)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.page_digests(warc.read_archives(files, payloads=False))


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = gru_lm.score(docs, docs.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return wavelet.checks(wavelet.read_shards(shards))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(read(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def quality_model(spark: SparkSession, sf_dir: str) -> line_crf.Model:
    """Fitted on labelled rows that are not held out."""
    return line_crf.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(~_held_out()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = line_crf.score(read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", _held_out().alias("held_out"), "score",
                         (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(read(spark, sf_dir, "embeddings"))
    table = written(codes.table, "codes")
    return vector_codes.label_errors(table).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie.sequences(read(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.rebuild(found))


REGISTRY = {"op1_benchmark_decontamination": op1_benchmark_decontamination,
            "op2_quality_rules": op2_quality_rules,
            "op3_simhash_near_dedup": op3_simhash_near_dedup, "op4_warc": op4_warc,
            "op5_gru_lm": op5_gru_lm,
            "op6_substring_dedup": op6_substring_dedup,
            "op7_wavelet_tokens": op7_wavelet_tokens,
            "op8_html_extraction": op8_html_extraction,
            "op9_byte_bpe": op9_byte_bpe,
            "op10_quality_classifier": op10_quality_classifier,
            "op11_vector_codes": op11_vector_codes, "op12_license_scan": op12_license_scan,
            "op13_conversation_trie": op13_conversation_trie}
SQL: dict[str, str] = {"op11_vector_codes": vector_codes.codes_sql(), "op12_license_scan": license_scan.scan_sql()}
