"""Evaluation jobs over routing, retrieval and conversation results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import metrics as M
from wayfind.operators import select as L
from wayfind.operators import sets as S
from wayfind.operators.scale import Ordered, join_lookup


def eval_single(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: was the best candidate the expected one?"""
    top = L.top_k(scores, 1).select("query", F.col("candidate").alias("predicted"))
    joined = truth.join(top, "query", "left")
    return joined.withColumn("correct", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)))


def eval_multi(scores: DataFrame, truth: DataFrame, gap: float = L.GAP, ratio: float = L.RATIO,
               bound: int | None = None) -> DataFrame:
    """Per query: does the gap selection equal the expected set?"""
    chosen = L.select_gap(scores, gap, ratio, bound).select("query", "candidate")
    counted = S.counts(chosen, truth.select("query", F.col("expected").alias("candidate")), ["query"], "candidate")
    return S.set_equal(counted, ["query"]).withColumnRenamed("equal", "correct")


def topk_accuracy(scores: DataFrame, truth: DataFrame, ks: Sequence[int], skip: str | None = None) -> DataFrame:
    """Share of queries whose expected candidate ranks within each ``k``."""
    if skip is not None:
        truth = truth.where(F.col("expected") != skip)
    return topk_scopes(scores, truth, ks, {"all": F.lit(True)}).drop("scope")


def topk_scopes(scores: DataFrame, truth: DataFrame, ks: Sequence[int], scopes: Mapping[str, Column]) -> DataFrame:
    """The shares of several parts of the queries, ``scopes`` by name, from one ranking: ``(scope, total, top...)``."""
    # Only the first max(ks) ranks matter.
    found = L.top_k(scores, max(ks)).join(
        truth.select("query", F.col("expected").alias("candidate")), ["query", "candidate"]
    ).select("query", "rank")
    joined = truth.join(found, "query", "left")
    inside = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in scopes.items()]), lambda s: s.isNotNull())
    hits = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"top{k}") for k in ks]
    counted = joined.withColumn("scope", F.explode(inside)).groupBy("scope").agg(F.count(F.lit(1)).alias("total"), *hits)
    # A part without a query has its row too.
    names = scores.sparkSession.createDataFrame([(name,) for name in scopes], "scope string")
    return names.join(counted, "scope", "left").fillna(0, ["total"])


def confusion(flagged: DataFrame, truth: DataFrame, on: str, predicted: str, actual: str) -> DataFrame:
    """Accuracy of a yes/no decision with both kinds of error."""
    joined = flagged.join(truth, on)
    p, a = F.col(predicted), F.col(actual)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    counts = joined.agg(
        F.count(F.lit(1)).alias("total"), n(p & a).alias("true_positive"), n(p & ~a).alias("false_positive"),
        n(~p & a).alias("false_negative"), n(~p & ~a).alias("true_negative"),
    )
    return counts.withColumn("accuracy", M.ratio(F.col("true_positive") + F.col("true_negative"), F.col("total")))


def contains_any(pairs: DataFrame, key: str, response: Column, truth: Column, *more: Column) -> DataFrame:
    """Does the response contain any of its truths, both in comparable form?

    An empty truth never counts.  ``more`` are further aggregates per key.
    """
    wanted = X.comparable(truth)
    hit = (F.length(wanted) > 0) & F.contains(X.comparable(response), wanted)
    return pairs.groupBy(key).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("contained"), *more)


def contains_any_of(responses: DataFrame, truths: DataFrame, on: Sequence[str], key: str, response: str, truth: str, block: int = 256) -> DataFrame:
    """As :func:`contains_any`, over the pairs that agree in ``on``.

    The truths of a key are lists of about ``block``, so that a response is brought
    into its form once per list, not once per pair.
    """
    wanted = truths.select(*on, X.comparable(F.col(truth)).alias("_w"))
    most = wanted.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("_w"), F.lit(-(-most // block))).alias("_part")
    lists = wanted.groupBy(*on, part).agg(F.collect_set("_w").alias("_wanted")).drop("_part")
    pairs = join_lookup(responses.select(*on, key, F.col(response).alias("_said")), lists, on)
    hit = X.let(X.comparable(F.col("_said")), lambda said: F.exists("_wanted", lambda w: (F.length(w) > 0) & F.contains(said, w)))
    return pairs.groupBy(key).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("contained"))


def turn_analysis(counted: DataFrame, entry: str, turn: Sequence[str], cls: Column) -> DataFrame:
    """Exact turns, missing and extra calls per class of entries."""
    diff = S.multiset_diff(counted)
    turns = diff.groupBy(*turn).agg(
        F.bool_and(F.col("n_pred") == F.col("n_true")).alias("exact"),
        F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
    )
    per_entry = turns.groupBy(entry).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.col("exact").cast("bigint")).alias("exact_turns"),
        F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
    )
    out = per_entry.groupBy(cls.alias("cls")).agg(
        F.sum("turns").alias("turns"), F.sum("exact_turns").alias("exact_turns"), F.count(F.lit(1)).alias("entries"),
        F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
    )
    return out.withColumn("accuracy", M.ratio(F.col("exact_turns"), F.col("turns")))


def path_summary(paths: DataFrame) -> DataFrame:
    return paths.agg(
        F.count(F.lit(1)).alias("conversations"), F.sum(F.col("passed").cast("bigint")).alias("passed"),
        F.avg("path_accuracy").alias("mean_path_accuracy"),
    )


def pad_turns(pred: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Call counts of every turn on either side; a missing side counts as empty."""
    p = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    q = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n_true"))
    joined = p.join(q, list(by), "full_outer")
    return joined.withColumn("padded", F.col("n_pred").isNull() | F.col("n_true").isNull()).fillna(0, ["n_pred", "n_true"])


def pattern_hit_rate(matches: DataFrame) -> DataFrame:
    """How often a pattern matched, and how often the empty one did."""
    return matches.agg(
        F.count(F.lit(1)).alias("turns"), F.count("pattern").alias("hits"),
        F.count(F.when(F.col("pattern") == L.EMPTY_PATTERN, 1)).alias("empty_hits"),
    ).withColumn("hit_rate", M.ratio(F.col("hits"), F.col("turns")))


def rule_coverage(forward: DataFrame, backward: DataFrame, action: str, func: str) -> DataFrame:
    """Actions without a function and functions without an action; none is expected."""
    missing_func = forward.select(action, func).join(backward.select(func).distinct(), func, "left_anti")
    missing_action = backward.select(action, func).join(forward.select(action).distinct(), action, "left_anti")
    return missing_func.select(F.lit("no function").alias("gap"), action, func).unionByName(
        missing_action.select(F.lit("no action").alias("gap"), action, func)
    )


def usage_delta(log: DataFrame, run: str, order: Sequence[str], split_on: Column, counter: str) -> DataFrame:
    """Usage of each entry from a counter that only grows within a run."""
    before = Ordered(log, [run], order, split_on).previous("_before", F.col(counter)).result()
    return before.withColumn("delta", F.col(counter) - F.coalesce("_before", F.lit(0))).drop("_before")
