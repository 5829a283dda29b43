"""The thin queries of the training-data operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from rollumen.llm import exact_dedup as exact
from rollumen.llm import divergence, extraction, kdtree, layouts, merkle, packing, pii, quality, toxicity
from rollumen.llm.bpe import round_trip
from rollumen.llm.common import documents, labels
from rollumen.llm.context_mixing import mixing_scores
from rollumen.llm.simhash import simhash_groups
from rollumen.llm.suffix_dedup import suffix_dedup


_SECRET = secrets.token_hex(32)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; another place can be given to the operators themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pseudonym_key(spark: SparkSession) -> str:
    """The session's spark.rollumen.pseudonyms.key; where it is unset, a secret of this process, so that equal values
    have equal pseudonyms in all its queries and nobody can turn them back."""
    return spark.conf.get("spark.rollumen.pseudonyms.key", None) or _SECRET


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymised(docs, pseudonym_key(spark)).select("doc_id", "n_private", "text")


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), extraction.fit(layouts.rendered(documents(spark, sf_dir))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(documents(spark, sf_dir))


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_kdtree_topk": op7_kdtree_topk,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_html_extraction": op12_html_extraction,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {"op5_exact_dedup": exact.ORACLE, "op7_kdtree_topk": kdtree.ORACLE, "op11_source_divergence": divergence.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
