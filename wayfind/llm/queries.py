"""The registered queries of this subpackage, and reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import dart_minhash, exact_dedup, fingerprints, language_id, merkle, packing, personal_data, piece_codec, prefix_trie, quality, reference_sql, suffix_dedup, tool_calls, toxicity
from wayfind.llm.common import fold


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")


def scored(docs: DataFrame, score, folds: int, held: int, threshold: float) -> DataFrame:
    """doc_id, whether its fold was held out of learning, the score, and the decision."""
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.fit(docs, labels(spark, folder), fold(F.col("doc_id"), 4) != 2)
    return scored(docs, quality.scorer(model), 4, 2, quality.THRESHOLD)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, labels(spark, folder), fold(F.col("doc_id"), 3) != 1)
    return scored(docs, toxicity.scorer(model), 3, 1, toxicity.THRESHOLD)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    predict = language_id.predictor(language_id.fit(docs, fold(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, predict(F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, folder))


def op5_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_classes(documents(spark, folder))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


def op7_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet")
    linked = tool_calls.linked_calls(*tool_calls.calls_of_conversations(turns), every_result=True)
    return linked.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "ordinal", "valid", F.size("errors").cast("bigint").alias("n_errors"), "message")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, folder))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op10_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encoded_digests(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.with_spans(documents(spark, folder).select("doc_id", "text"), "found").drop("text")
    base = personal_data.base_only(F.col("found"))
    return found.select(
        "doc_id", *[personal_data.counted(base, kind).alias(f"n_{kind}") for kind in personal_data.BASE],
        F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(F.col("found")).alias("spans"),
    )


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # Tampering lower-cases the letters A to Z of some texts.
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select(
        F.col("source").alias("grp"), F.col("doc_id").alias("ord"), merkle.sealed(*fields).alias("leaf"),
        F.when(fold(F.col("doc_id"), 5) == 0, merkle.sealed(*fields[:-1], lowered)).alias("changed"),
    )
    return merkle.manifest(leaves).withColumnRenamed("ord", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality,
        op2_toxicity,
        op3_language_id,
        op4_order_minhash,
        op5_dart_minhash,
        op6_exact_dedup,
        op7_tool_calls,
        op8_suffix_dedup,
        op9_packing,
        op10_piece_codec,
        op11_personal_data,
        op12_prefix_trie,
        op13_merkle_manifest,
    )
}

SQL = {
    "op6_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d JOIN (
            SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1
        ) g ON coalesce(d.text, '') = g.body
    """,
    "op7_tool_calls": """
        WITH calls AS (
            SELECT conv_id, turn, text, coalesce(length(text), 0) AS n FROM conversations WHERE role = 'user'
        ), edged AS (
            SELECT *, n % 11 = 0 AND EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 2) AS behind
            FROM calls c
        ), keyed AS (
            -- a run of calls that each wait for the next but one ends with a call that doesn't
            SELECT *, min(CASE WHEN NOT behind THEN turn END) OVER (
                PARTITION BY conv_id, turn % 2 ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last
            FROM edged
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last, last - turn, turn) - 1 AS ordinal FROM keyed
        ), checked AS (
            SELECT *,
                'call_' || turn AS call_id,
                CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'note' END AS name,
                CASE
                    WHEN n % 3 = 0 AND n % 5 = 0 THEN json_object('limit', n::VARCHAR, 'query', text)
                    WHEN n % 3 = 0 THEN json_object('limit', n, 'query', text)
                    WHEN n % 3 = 1 AND n % 7 = 0 THEN json_object('exact', n > 99)
                    WHEN n % 3 = 1 THEN json_object('exact', n > 99, 'key', text)
                    WHEN n % 4 = 0 THEN json_object('extra', 1, 'text', text)
                    ELSE json_object('text', text)
                END AS arguments,
                CASE
                    WHEN n % 3 = 0 THEN list_filter([CASE WHEN text IS NULL THEN 'missing query' END, CASE WHEN n % 5 = 0 THEN 'not integer limit' END], lambda x: x IS NOT NULL)
                    WHEN n % 3 = 1 AND (n % 7 = 0 OR text IS NULL) THEN ['missing key']
                    WHEN n % 3 = 2 THEN list_filter([CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN n % 4 = 0 THEN 'unknown extra' END], lambda x: x IS NOT NULL)
                    ELSE []::VARCHAR[]
                END AS errors
            FROM numbered
        ), answers AS (
            SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(text) AS result FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
        )
        SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.ordinal AS ordinal,
            c.conv_id IS NOT NULL AND len(c.errors) = 0 AS valid,
            CASE WHEN c.conv_id IS NULL THEN 1 ELSE len(c.errors) END::BIGINT AS n_errors,
            json_object('arguments', c.arguments, 'errors', CASE WHEN c.conv_id IS NULL THEN ['no call'] ELSE c.errors END,
                'id', coalesce(c.call_id, a.call_id), 'name', c.name, 'ordinal', c.ordinal, 'result', a.result)::VARCHAR AS message
        FROM checked c FULL JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
    """,
    "op12_prefix_trie": reference_sql.TRIE,
    "op13_merkle_manifest": reference_sql.manifest(),
}
