"""Metrics that grow with the results, and a catalog that grows with updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.operators import metrics as M
from wayfind.sources import catalog as C
from wayfind.streaming.io import drain, replace_batch


def metrics_stream(results: DataFrame, entry: str, category: str, correct: str, latency: str, folder: str) -> str:
    """Results as they complete, each entry once, as counts per batch of ``(category, correct, latency)``.

    Entries are keys of the state store (RocksDB, see :mod:`sessions`): a batch
    looks up its own entries and reads nothing of what was written before.  Of
    an entry that is delivered again, however late, the first batch's content
    stays, and within one batch the least by category, correct and latency.
    Results without an entry are one entry.
    """
    out = f"{folder}/results"
    # All rows of a batch carry its time: an entry of one time only is in its first batch.
    told = results.select(
        F.col(entry).alias("entry"), F.current_timestamp().alias("at"),
        F.struct(F.col(category).alias("category"), F.col(correct).alias("correct"), F.col(latency).alias("latency")).alias("told"))
    entries = told.groupBy("entry").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("told").alias("told"))
    fresh = entries.where(F.col("first") == F.col("last")).select("told.*")

    def each(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("category", "correct", "latency").agg(F.count(F.lit(1)).alias("n"))
        replace_batch(counts.select(F.col("category").alias(category), F.col("correct").alias(correct), F.col("latency").alias(latency), "n"), number, out)

    drain(fresh, folder, each, "update")
    return out


def report(counts: DataFrame, category: str, correct: str, latency: str) -> DataFrame:
    """Accuracy, mean and p95 of the results so far, from the counts ``n`` of all batches."""
    counts = counts.groupBy(category, correct, latency).agg(F.sum("n").alias("n"))
    sums = counts.groupBy(category).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col(correct), F.col("n")).otherwise(0)).alias("correct"),
        F.try_divide(F.sum(F.col(latency) * F.col("n")), F.sum("n")).alias("mean"),
    ).withColumn("accuracy", M.ratio(F.col("correct"), F.col("total")))
    p95 = M.nearest_rank_counted(counts.groupBy(category, latency).agg(F.sum("n").alias("n")), [category], latency, "n", 0.95)
    return sums.join(p95.withColumnRenamed("quantile", "p95"), category)


def catalog_updates(updates: DataFrame, keys: Sequence[str], version: Sequence[str], folder: str) -> str:
    """Append every batch's last write per key; readers take the latest.

    Appending keeps the cost of a batch at the size of the batch; a batch run
    twice replaces its own partition.
    """
    out = f"{folder}/catalog"
    drain(updates, folder, lambda batch, number: replace_batch(C.latest(batch, keys, version), number, out))
    return out
