"""Ranking, top-k, threshold, gap and merge rules over ``(query, candidate, score)``.

Ties always go to the smaller candidate.  A ``rank <= k`` filter on a row number
is applied by Spark before the shuffle as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.scale import Ordered


def by_score(query: str = "query", tie: str = "candidate") -> Window:
    return Window.partitionBy(query).orderBy(F.desc("score"), tie)


def _in_order(scores: DataFrame, bound: int | None) -> Ordered:
    """Candidates of each query from the best down.

    ``bound`` is the size of the catalog where it is known.
    """
    return Ordered(
        scores.withColumn("_down", -F.col("score")), ["query"], ["_down", "candidate"], F.col("_down"), bound=bound
    )


def rank(scores: DataFrame, bound: int | None = None) -> DataFrame:
    """Full ranking per query."""
    return _in_order(scores, bound).row_number("rank").result().drop("_down")


def top_k(scores: DataFrame, k: int, query: str = "query", tie: str = "candidate") -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(by_score(query, tie)))
    return ranked.where(F.col("rank") <= k)


def narrow(scores: DataFrame, queries: DataFrame, fallback: DataFrame, k: int = 3, threshold: float = 0.05) -> DataFrame:
    """Top ``k`` above the threshold; a query with none gets the first of the catalog.

    ``fallback(candidate, ord)`` holds the first ``k`` catalog rows.
    """
    chosen = top_k(scores, k).where(F.col("score") > threshold).select("query", "candidate", "rank", F.lit(False).alias("is_fallback"))
    empty = queries.select("query").join(chosen.select("query").distinct(), "query", "left_anti")
    # The catalog head has at most k rows; it becomes an array on every empty query.
    head = [(r["candidate"], r["ord"]) for r in fallback.where(F.col("ord") <= k).limit(k).collect()]
    items = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(o).cast("int").alias("rank")) for c, o in head])
    filled = empty.select("query", F.explode(items).alias("f")).select("query", "f.candidate", "f.rank", F.lit(True).alias("is_fallback"))
    return chosen.unionByName(filled)


GAP, RATIO = 0.75, 0.20


def select_gap(scores: DataFrame, gap: float = GAP, ratio: float = RATIO, bound: int | None = None) -> DataFrame:
    """Take ranked candidates until the first large drop.

    Stops at a relative drop above ``gap``, a share of the best below ``ratio``
    or a previous score of 0 or less.  Nothing is taken if the best is 0 or less,
    except for a lone candidate.
    """
    ordered = _in_order(scores, bound)
    ordered.row_number("rank").previous("_prev", F.col("score")).first("_best", F.col("score")).following("_more", F.lit(1))
    drop = F.try_divide(F.col("_prev") - F.col("score"), F.col("_prev")) > gap
    low = F.try_divide(F.col("score"), F.col("_best")) < ratio
    stop = F.when(F.col("rank") == 1, (F.col("_best") <= 0) & F.col("_more").isNotNull()).otherwise(
        (F.col("_prev") <= 0) | F.coalesce(drop, F.lit(True)) | F.coalesce(low, F.lit(True))
    )
    ordered.with_column("_stop", stop.cast("int")).running("_stopped", F.col("_stop"))
    kept = ordered.result().where(F.col("_stopped") == 0)
    return kept.drop("_prev", "_best", "_more", "_stop", "_stopped", "_down")


def prune_classes(scores: DataFrame, cls: str, delta: float = 0.15) -> DataFrame:
    """Keep the candidates of classes whose best is within ``delta`` of the best.

    Grouped maxima instead of windows: they combine before the shuffle.
    """
    per_class = scores.groupBy("query", cls).agg(F.max("score").alias("_class_best"))
    best = per_class.groupBy("query").agg(F.max("_class_best").alias("_best"))
    near = per_class.join(best, "query").where(F.col("_class_best") >= F.col("_best") - F.lit(delta))
    return scores.join(near.select("query", cls), ["query", cls], "left_semi")


def merge_candidates(stages: Sequence[DataFrame], bare: Column) -> DataFrame:
    """Merge ranked lists ``(query, candidate, ord)``: earlier stages go first.

    A bare name counts once per query, at its first place.  A query's places are
    counted in pieces where it has very many.
    """
    union = None
    for number, stage in enumerate(stages):
        rows = stage.select("query", "candidate", F.lit(number).alias("stage"), F.col("ord").cast("double").alias("ord"))
        union = rows if union is None else union.unionByName(rows)
    first = union.groupBy("query", bare.alias("bare")).agg(F.min(F.struct("stage", "ord", "candidate")).alias("_at"))
    # Never falls in the order: the stage, and in it the place squeezed between 0 and 1.
    falls = F.col("stage") + 0.5 + 0.5 * F.col("ord") / (1 + F.abs("ord"))
    rows = first.select("query", "bare", "_at.*")
    ordered = Ordered(rows, ["query"], ["stage", "ord", "candidate"], F.coalesce(falls, F.col("stage").cast("double")))
    return ordered.row_number("position").result().select("query", "bare", "candidate", "stage", F.col("position").cast("int").alias("position"))


def suggest(direct: DataFrame, scores: DataFrame, cls: str, per_class: int = 3) -> DataFrame:
    """Direct action hits (score 1) before the best of each class, no repeats."""
    mapped = direct.select("query", "candidate", F.lit(1.0).alias("score"), F.lit(0).alias("stage"))
    window = Window.partitionBy("query", cls).orderBy(F.desc("score"), "candidate")
    best = scores.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= per_class)
    both = mapped.unionByName(best.select("query", "candidate", "score", F.lit(1).alias("stage")))
    first = both.groupBy("query", "candidate").agg(F.min_by(F.struct("stage", "score"), F.struct("stage", -F.col("score"))).alias("_s"))
    return first.select("query", "candidate", "_s.score", F.when(F.col("_s.stage") == 0, "action_map").otherwise("similarity").alias("source"))


def top_of_classes(scores: DataFrame, cls: str, per_class: int = 3, k: int = 5) -> DataFrame:
    """Top ``k`` over the top ``per_class`` of every class."""
    window = Window.partitionBy("query", cls).orderBy(F.desc("score"), "candidate")
    best = scores.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= per_class).drop("_r")
    return top_k(best, k)


PATTERN_THRESHOLD = 0.45
EMPTY_PATTERN = "[]"


def match_pattern(scores: DataFrame, queries: DataFrame, base: Column, threshold: float = PATTERN_THRESHOLD) -> DataFrame:
    """Best non-empty pattern per query; below the threshold only its score stays."""
    by_base = scores.groupBy("query", base.alias("candidate")).agg(F.max("score").alias("score"))
    best = top_k(by_base.where(F.col("candidate") != EMPTY_PATTERN), 1)
    joined = queries.select("query").join(best, "query", "left")
    return joined.select(
        "query",
        F.when(F.col("score") >= threshold, F.col("candidate")).alias("pattern"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def separation(scores: DataFrame, margin: float = 0.01) -> DataFrame:
    """Distance between the two best candidates, and whether it is clear."""
    two = top_k(scores, 2).groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    return two.withColumn("margin", F.col("first") - F.col("second")).withColumn("clear", F.col("margin") > margin)


def first_distinct(rows: DataFrame, func: str, text: str, order: str, n: int) -> DataFrame:
    """First ``n`` distinct texts per function (lower-case, trimmed); originals kept."""
    norm = F.lower(F.trim(text))
    first = rows.where(F.col(text).isNotNull()).groupBy(func, norm.alias("_norm")).agg(
        F.min_by(F.trim(text), order).alias(text), F.min(order).alias("_first")
    )
    window = Window.partitionBy(func).orderBy("_first")
    return first.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n).drop("_norm", "_first")
