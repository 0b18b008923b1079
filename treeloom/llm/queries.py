"""The queries of the numbered operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, language_id, lm_scoring, merkle, mixing, ngram_join, prefix_trie, substring_dedup, token_counts, url_filter, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, docs.where(~lm_scoring.held_out()))
    return scored.select("doc_id", lm_scoring.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return bpe.digests(coded)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "removed_sentences", "removed_words", "text")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = language_id.fit(docs.where(~language_id.held_out()))
    named = language_id.identify(docs, field, keep=["doc_id"])
    return named.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.formatted(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return merkle.proofs(merkle.manifest(docs, merkle.tampered()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_lm_score": op1_lm_score,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest": op5_nearest,
    "op6_url_filter": op6_url_filter,
    "op7_top_products": op7_top_products,
    "op8_mix": op8_mix,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_merkle_manifest": op13_merkle_manifest,
}
