"""Passage retrieval by sliding windows of clauses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import evaluate as K
from wayfind.operators import similarity as S
from wayfind.operators.features import MEMORY
from wayfind.operators.scale import Ordered, hold_if_small

WINDOW, TOP = 3, 50


def text_windows(clauses: Column, size: int = WINDOW) -> Column:
    """Windows of one text: each clause with the ``size - 1`` after it."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(clauses), F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(clauses, i, F.lit(size)), " "))
    return F.when(F.size(clauses) > 0, windows).otherwise(F.array().cast("array<string>"))


def document_windows(documents: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """Windows inside each document, as a projection: ``(key, pos, passage)``."""
    clauses = documents.select(key, X.clauses(F.col(text)).alias("_c"))
    rows = clauses.select(key, F.posexplode_outer(text_windows(F.col("_c"), size)).alias("pos", "passage"))
    return rows.where(F.col("pos").isNotNull())


def conversation_windows(utterances: DataFrame, key: str, order: Sequence[str], split_on: Column, text: str,
                         size: int = WINDOW) -> DataFrame:
    """Windows over all clauses of a conversation, across its messages.

    Clauses are numbered by a running sum of clause counts; each goes to the
    ``size`` windows it is part of, so that a group never has more than ``size``
    rows.
    """
    parts = utterances.select(key, *order, split_on.alias("_at"), X.clauses(F.col(text)).alias("_c"))
    numbered = Ordered(parts, [key], order, F.col("_at")).running("_upto", F.size("_c")).result()
    clauses = numbered.select(key, (F.col("_upto") - F.size("_c")).alias("_from"), F.posexplode_outer("_c").alias("_i", "clause"))
    clauses = clauses.where(F.col("_i").isNotNull()).select(key, (F.col("_from") + F.col("_i")).alias("pos"), "clause")
    members = clauses.select(
        key, "pos", "clause",
        F.explode(F.sequence(F.greatest(F.col("pos") - (size - 1), F.lit(0)), F.col("pos"))).alias("start"),
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", "clause")))
    return members.groupBy(key, F.col("start")).agg(
        F.array_join(F.transform(rows, lambda r: r["clause"]), " ").alias("passage")
    ).withColumnRenamed("start", "pos")


def encode_passages(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word bags of the windows; windows without a word are left out."""
    tokens = windows.select(*keys, X.memory_tokens(F.col("passage")).alias("_t"))
    return tokens.where(F.size("_t") > 0).select(*keys, F.array_distinct("_t").alias("words"))


def encode_documents(documents: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """Word bags of the windows inside each document, ``(key, pos, words)``: as :func:`encode_passages` of :func:`document_windows`.

    A window's words are those of its clauses, so each clause is cut into words
    once, not once per window that it is part of.
    """
    clauses = documents.select(key, F.transform(X.clauses(F.col(text)), lambda c: F.array_distinct(X.memory_tokens(c))).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)))
    bags = F.transform(starts, lambda i: F.array_distinct(F.flatten(F.slice("_w", i, F.lit(size)))))
    rows = clauses.select(key, F.posexplode_outer(bags).alias("pos", "words"))
    return rows.where(F.size("words") > 0)


def encode_questions(questions: DataFrame, key: str, text: str) -> DataFrame:
    tokens = questions.select(key, X.memory_tokens(F.col(text)).alias("_t"))
    return tokens.where(F.size("_t") > 0).select(key, F.array_distinct("_t").alias("words"))


def retrieve(windows: DataFrame, keys: Sequence[str], questions: DataFrame, question_key: str, text: str, k: int = TOP) -> DataFrame:
    """Best ``k`` windows per question: ``(query, keys..., score, rank)``, for two or more ``keys`` of a window.

    A counted set of questions is scored inside the rows of the windows.
    """
    return best_passages(encode_passages(windows, keys), keys, questions, question_key, text, k)


def best_passages(passages: DataFrame, keys: Sequence[str], questions: DataFrame, question_key: str, text: str, k: int = TOP) -> DataFrame:
    """The same for windows that are encoded already."""
    return S.top_k(encode_questions(questions, question_key, text), passages, MEMORY, question_key, list(keys), k)


def answer(hits: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts of the hits in score order, joined (at most ``k`` per question).

    The passages join back after the cut: the ranking moves keys only.
    """
    texts = windows.select(*keys, "passage")
    rows = F.array_sort(F.collect_list(F.struct("rank", "passage")))
    joined = texts.join(hold_if_small(hits), list(keys)).groupBy("query").agg(
        F.array_join(F.transform(rows, lambda r: r["passage"]), " ").alias("answer")
    )
    return joined


def evaluate(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Does each answer hold the expected text? ``truth(query, expected)``."""
    pairs = truth.join(answers, "query", "left")
    return K.contains_any(pairs, "query", F.coalesce("answer", F.lit("")), F.col("expected"))
