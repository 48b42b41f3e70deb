"""From raw documents to packed training sequences, one stage at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import dart_minhash, exact_dedup, packing, quality, suffix_dedup
from wayfind.llm.common import fold, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model takes for label 1 stay; it learns from the labels outside one fold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = quality.scorer(quality.fit(docs, labels, fold(F.col("doc_id"), 4) != 2))
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one with the least id."""
    return dart_minhash.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the passages that an earlier one has; ``n_chars`` follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of 2048 tokens; workers that run all stages don't keep the tokenizer."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("passage_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Models and tokenizers take part: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
