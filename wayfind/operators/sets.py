"""Set, multiset and sequence comparison of predicted and expected calls.

Everything is done with counts per name, so that a group with very many calls is
never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.operators.metrics import ratio


def counts(pred: DataFrame, truth: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Occurrences of each name on both sides: ``(by, name, n_pred, n_true)``."""
    both = pred.select(*by, name, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(
        truth.select(*by, name, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    )
    return both.groupBy(*by, name).agg(F.sum("_p").alias("n_pred"), F.sum("_t").alias("n_true"))


def set_equal(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    same = (F.col("n_pred") > 0) == (F.col("n_true") > 0)
    return counted.groupBy(*by).agg(F.bool_and(same).alias("equal"))


def multiset_equal(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted.groupBy(*by).agg(F.bool_and(F.col("n_pred") == F.col("n_true")).alias("equal"))


def multiset_diff(counted: DataFrame) -> DataFrame:
    """How often a name is missing from, or extra in, the prediction."""
    return counted.withColumn("missing", F.greatest(F.col("n_true") - F.col("n_pred"), F.lit(0))).withColumn(
        "extra", F.greatest(F.col("n_pred") - F.col("n_true"), F.lit(0))
    )


PASS_PATH = 0.5


def path_accuracy(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of expected calls that were predicted; 1 without expected calls."""
    hit = F.sum(F.least("n_pred", "n_true"))
    sums = counted.groupBy(*by).agg(hit.alias("matched"), F.sum("n_true").alias("expected"))
    value = F.when(F.col("expected") > 0, ratio(F.col("matched"), F.col("expected"))).otherwise(1.0)
    return sums.withColumn("path_accuracy", value).withColumn("passed", F.col("path_accuracy") >= PASS_PATH)


def sequence_equal(pred: DataFrame, truth: DataFrame, by: Sequence[str], position: str, content: str) -> DataFrame:
    """Equal length and equal content at every position."""
    both = pred.select(*by, position, F.col(content).alias("_p")).join(
        truth.select(*by, position, F.col(content).alias("_t")), [*by, position], "full_outer"
    )
    return both.groupBy(*by).agg(F.bool_and(F.col("_p").eqNullSafe(F.col("_t"))).alias("equal"))


def ordered_union(first: DataFrame, second: DataFrame, by: Sequence[str], name: str, order: str) -> DataFrame:
    """Distinct names: those of the first side in order, then new ones of the second."""
    staged = first.select(*by, name, F.struct(F.lit(0).alias("stage"), F.col(order).alias("o")).alias("_at")).unionByName(
        second.select(*by, name, F.struct(F.lit(1).alias("stage"), F.col(order).alias("o")).alias("_at"))
    )
    names = staged.groupBy(*by, name).agg(F.min("_at").alias("_at"))
    # The names of a group come out of a catalog: few, however many calls there are.
    return names.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", name))), lambda s: s[name]).alias("names")
    )
