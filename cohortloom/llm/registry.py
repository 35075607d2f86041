"""Queries of the training-data operators: opN_<name> and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm.decontaminate import find_leaks
from cohortloom.llm.divergence import source_divergence
from cohortloom.llm.embedding_dedup import link_embeddings
from cohortloom.llm.language import identify_language
from cohortloom.llm.language_model import language_model_scores
from cohortloom.llm.licenses import scan_licenses
from cohortloom.llm.manifest import verify_manifest
from cohortloom.llm.minhash import near_duplicates
from cohortloom.llm.mixing import mix_sources
from cohortloom.llm.oracles import ORACLES
from cohortloom.llm.quality import classify_quality
from cohortloom.llm.repeats import repeated_bytes
from cohortloom.llm.rules import judge_quality
from cohortloom.llm.shared import table
from cohortloom.llm.toxicity import classify_toxicity


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_manifest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_suffix_array": op8_suffix_array,
    "op9_lm_scores": op9_lm_scores,
    "op10_mixing": op10_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_divergence": op13_source_divergence,
}
