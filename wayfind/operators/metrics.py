"""Evaluation aggregates.

All group sums combine before the shuffle.  Statistics that need the order of a
group's values count equal values first and use :class:`Ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.operators.scale import Ordered, join_lookup


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(results: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    """Total, correct and ratio per group."""
    right = F.sum(F.col(correct).cast("bigint"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(right, F.lit(0)).alias("correct")
    ).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


USAGE = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "api_calls")


def usage(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of all counters per group, and input + output as the total."""
    sums = results.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in USAGE])
    return sums.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def cost(summed: DataFrame, prices: DataFrame, tier: str = "tier") -> DataFrame:
    """Price of summed usage; cached input is billed at its own rate.

    ``prices(tier, p_in, p_out, p_cache_write, p_cache_read)`` is per million.
    """
    million = F.lit(1_000_000.0)
    uncached = F.greatest(F.col("input_tokens") - F.col("cache_read_tokens"), F.lit(0))
    total = (
        uncached / million * F.col("p_in")
        + F.col("cache_write_tokens") / million * F.col("p_cache_write")
        + F.col("cache_read_tokens") / million * F.col("p_cache_read")
        + F.col("output_tokens") / million * F.col("p_out")
    )
    priced = join_lookup(summed, prices, [tier], "left").withColumn("cost", total)
    return priced.drop("p_in", "p_out", "p_cache_write", "p_cache_read")


def nearest_rank(values: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Nearest-rank quantile: the smallest value with ``ceil(q n)`` rows up to it.

    Equal values are counted first; the running count survives a hot group.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return nearest_rank_counted(counted, by, value, "_c", q)


def nearest_rank_counted(counted: DataFrame, by: Sequence[str], value: str, count: str, q: float) -> DataFrame:
    """The same from values that are counted already, one row per distinct value."""
    totals = counted.groupBy(*by).agg(F.sum(count).alias("_n"))
    running = Ordered(counted, by, [value], F.col(value)).running("_upto", F.col(count)).result()
    reached = join_lookup(running, totals, by).where(F.col("_upto") >= F.ceil(F.lit(q) * F.col("_n")))
    return reached.groupBy(*by).agg(F.min(value).alias("quantile"))


def latency(results: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single value) and nearest-rank p95."""
    stats = results.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )
    p95 = nearest_rank(results, by, value, 0.95).withColumnRenamed("quantile", "p95")
    return stats.join(p95, list(by), "left")


# Weight of each section in the overall score.
SECTION_WEIGHTS = {"agentic": 0.40, "multi_turn": 0.30, "non_live": 0.10, "hallucination": 0.10, "live": 0.10}


def composite(categories: DataFrame, weights: DataFrame) -> DataFrame:
    """Category accuracy -> section mean -> weighted overall score.

    ``categories(category, sub_section, section, accuracy)``: a section with
    sub-sections is the mean of their means.  Weights renormalise over the
    sections present; ``weight_covered`` tells how much of them there is.
    """
    subs = categories.groupBy("section", "sub_section").agg(F.avg("accuracy").alias("score"))
    sections = subs.groupBy("section").agg(F.avg("score").alias("score"))
    weighted = join_lookup(sections, weights, ["section"])
    return weighted.groupBy().agg(
        F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("overall"),
        F.sum("weight").alias("weight_covered"),
    )


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def best_variant(scores: DataFrame, query: str, base: Column, score: str) -> DataFrame:
    """Best score over the variants of each function."""
    return scores.groupBy(query, base.alias("base")).agg(F.max(score).alias("score"))


def function_stats(pairs: DataFrame, func: str, text: str) -> DataFrame:
    """Total and distinct (lower-case, trimmed) queries per function."""
    norm = F.lower(F.trim(text))
    return pairs.groupBy(func).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(norm).alias("distinct_queries"))


def top_counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most frequent values: a report list, not a sample."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def vote(rows: DataFrame, group: str, choice: str, order: str, ignore: str = "none") -> DataFrame:
    """Most frequent choice per group; the first seen wins a tie."""
    counted = rows.where(F.col(choice) != ignore).groupBy(group, choice).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    groups = rows.select(group).distinct()
    winners = counted.groupBy(group).agg(
        F.max_by(choice, F.struct(F.col("_n"), -F.col("_first"))).alias(choice)
    )
    return groups.join(winners, group, "left").withColumn(choice, F.coalesce(choice, F.lit(ignore)))


def distinct_values(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sorted distinct values per group.

    The pairs are made distinct first; the values are names out of a catalog.
    """
    return rows.select(group, value).distinct().groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"))


def perfect(turns: DataFrame, entry: str, exact: str) -> DataFrame:
    """An entry is perfect if all its turns are exact."""
    return turns.groupBy(entry).agg(F.bool_and(exact).alias("perfect"))


def average_confidence(scores: DataFrame, selected: DataFrame, query: str, candidate: str, score: str) -> DataFrame:
    """Mean score over the selected candidates of each query."""
    return scores.join(selected, [query, candidate], "left_semi").groupBy(query).agg(F.avg(score).alias("confidence"))


def compare_versions(rows: DataFrame, by: str, version: str, value: Column, old, new) -> DataFrame:
    """One column per version and the change between them."""
    wide = rows.groupBy(by).agg(
        F.avg(F.when(F.col(version) == F.lit(old), value)).alias("old"),
        F.avg(F.when(F.col(version) == F.lit(new), value)).alias("new"),
    )
    return wide.withColumn("delta", F.col("new") - F.col("old"))


def _counted_tokens(queries: DataFrame, func: str, order: str, tokens: Column, first: int | None, cut: int | None) -> DataFrame:
    head = queries.withColumn("_q", F.col(order))
    if first is not None:
        head = head.withColumn("_q", F.row_number().over(Window.partitionBy(func).orderBy(order))).where(F.col("_q") <= first)
    placed = head.select(func, "_q", F.posexplode_outer(tokens).alias("_pos", "token"))
    # An inner explode would have its filter compute the tokens a second time.
    counted = placed.where("token is not null").groupBy(func, "token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_q", "_pos")).alias("_seen")
    )
    by_count = Window.partitionBy(func).orderBy(F.desc("n"), "_seen")
    cut_rows = counted.withColumn("_r", F.row_number().over(by_count))
    return cut_rows if cut is None else cut_rows.where(F.col("_r") <= cut)


def ranked_tokens(queries: DataFrame, func: str, order: str, text: str, tokens: Column,
                  first: int | None = None, cut: int | None = None) -> DataFrame:
    """Tokens of the queries of each function in the order of :func:`top_tokens`, as the array ``ranked``.

    A text that is the only query of its functions is counted once, whatever their number.
    """
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("_r", "token"))), lambda r: r["token"]).alias("ranked")
    texts = queries.select(F.col(text).alias("_text")).distinct().withColumn(text, F.col("_text")).withColumn(order, F.lit(0))
    lists = checkpointed(_counted_tokens(texts, "_text", order, tokens, None, cut).groupBy("_text").agg(ranked))
    asked = queries.groupBy(func).agg(F.count(F.lit(1)).alias("_n"), F.first(text).alias("_text"))
    single = join_lookup(asked.where("_n = 1").select(func, "_text"), lists, ["_text"]).select(func, "ranked")
    several = asked.where("_n > 1").select(func)
    if several.isEmpty():
        return single
    rest = join_lookup(queries, several, [func], "left_semi")
    return single.unionByName(_counted_tokens(rest, func, order, tokens, first, cut).groupBy(func).agg(ranked))


def top_tokens(queries: DataFrame, func: str, order: str, tokens: Column, shared: DataFrame,
               first: int | None = None, cut: int | None = None, keep: int | None = None) -> DataFrame:
    """Frequent tokens of the queries of each function.

    Count over (the first ``first``) queries, (cut at ``cut``) by count (first seen
    breaks ties), then drop the shared tokens and keep all (``keep``).
    """
    cut_rows = _counted_tokens(queries, func, order, tokens, first, cut)
    left = cut_rows.join(shared.select(func, "token"), [func, "token"], "left_anti")
    again = F.row_number().over(Window.partitionBy(func).orderBy("_r"))
    placed = left.withColumn("rank", again).select(func, "token", "n", "rank")
    return placed if keep is None else placed.where(F.col("rank") <= keep)


def shared_tokens(catalog: DataFrame, cls: str, distinct_tokens: Column) -> DataFrame:
    """Tokens found in every description of a class with more than one function.

    They are among the tokens of the class's shortest description: only those are counted.
    """
    described = catalog.select(cls, distinct_tokens.alias("_tokens"))
    length = F.coalesce(F.size("_tokens"), F.lit(-1))
    sizes = checkpointed(described.groupBy(cls).agg(F.count(F.lit(1)).alias("_size"), F.min(length).alias("_least")).where("_size > 1 and _least > 0"))
    least = join_lookup(described, sizes, [cls]).where(length == F.col("_least"))
    shortest = checkpointed(least.groupBy(cls, "_size").agg(F.first("_tokens").alias("_few")))
    met = join_lookup(described, shortest, [cls])
    counts = met.select(cls, "_size", F.explode_outer(F.array_intersect("_few", "_tokens")).alias("token"))
    return counts.groupBy(cls, "_size", "token").agg(F.count(F.lit(1)).alias("_n")).where(
        (F.col("_n") == F.col("_size")) & F.col("token").isNotNull()
    ).select(cls, "token")
