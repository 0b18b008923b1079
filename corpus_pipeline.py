"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, mixing to target weights, BPE.

Each stage works on all rows that its predecessor kept; its result is written as Parquet and read again as the next one's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, language_id, mixing, ngram_join, substring_dedup
from treeloom.llm.common import saved, shielded

#: Below this mean probability of its language a document has none (with four languages, chance is 0.25).
LEAST_LANGUAGE_SCORE = 0.4


def only_named_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are `und`, or whose language is a guess, go. The field learns from a bounded sample of docs; where docs
    name no language, nothing is learned, every document is `und`, and none stays."""
    return _named(docs)


@shielded
def _named(docs: DataFrame) -> DataFrame:
    field = language_id.fit(docs)
    named = language_id.identify(docs, field, keep=docs.columns)
    kept = named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays."""
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans go from the texts; a document of which nothing is left goes too."""
    return _cleaned(docs)


@shielded
def _cleaned(docs: DataFrame) -> DataFrame:
    cleaned = substring_dedup.dedup(docs)
    left = cleaned.where((F.col("removed_sentences") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(F.col("removed_sentences") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the decoded text of every row."""
    coded = bpe.encode(docs, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", only_named_languages),
    ("ngram_join", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_to_weights),
    ("bpe", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has neither the trained field nor MinHash nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None
