"""Vectors against labelled centroids in blocks: every score, or the best few of each vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.functions import vectors as V
from wayfind.operators.scale import is_small

BLOCK = 256
DIGITS = 9


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean per place, combined before the shuffle; one scan, whatever the width."""
    places = vectors.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = places.groupBy(label, "i").agg(F.avg("x").alias("m"))
    items = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(label).agg(F.transform(items, lambda s: s["m"]).alias("centroid"))


class CentroidBlocks:
    """Centroids in rows of about ``block`` each; nothing of them is held by the driver but their number."""

    def __init__(self, table: DataFrame, label: str, centroid: str = "centroid", block: int = BLOCK):
        self.table = checkpointed(table.select(F.col(label).alias("label"), F.col(centroid).alias("centroid")))
        self.labels = self.table.count()
        self.blocks = max(1, -(-self.labels // block))
        item = F.struct("label", "centroid", V.norm(F.col("centroid")).alias("norm"))
        rows = self.table.groupBy(F.pmod(F.xxhash64("label"), F.lit(self.blocks)).alias("_block")).agg(F.collect_list(item).alias("_items"))
        self.rows = checkpointed(rows)
        self.small = is_small(self.rows)

    def scores(self, vectors: DataFrame, key: str, vector: str, k: int | None = None) -> DataFrame:
        """``(query, candidate, score)`` of every vector and label, or of each vector's best ``k`` per block.

        A vector meets every block once.  With ``k`` a row gives away at most
        ``k`` scores per block, the ties by the smaller label.
        """
        asked = vectors.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("_v"))
        asked = asked.withColumn("_n", V.norm(F.col("_v")))
        if self.blocks > 1:
            asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.blocks - 1).cast("bigint"))))
        else:
            asked = asked.withColumn("_block", F.lit(0).cast("bigint"))
        met = asked.join(F.broadcast(self.rows) if self.small else self.rows, "_block")
        found = F.transform("_items", lambda c: F.struct(
            (-F.round(self._cosine(c), DIGITS)).alias("down"), c["label"].alias("label")))
        if k is not None:
            found = F.slice(F.array_sort(found), 1, k)
        rows = met.select("query", F.explode(found).alias("s"))
        return rows.select("query", F.col("s.label").alias("candidate"), (-F.col("s.down")).alias("score"))

    @staticmethod
    def _cosine(c: Column) -> Column:
        scale = F.col("_n") * c["norm"]
        return F.when(scale > 0, V.dot(F.col("_v"), c["centroid"]) / scale).otherwise(0.0)
