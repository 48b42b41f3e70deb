"""The function catalog as a Parquet table partitioned by class."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last write per key; combines before the shuffle, whatever a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Merge updates into a table: per key the update wins, among updates the last."""
    old = current.withColumn("_batch", F.lit(0))
    new = updates.withColumn("_batch", F.lit(1))
    return latest(old.unionByName(new), keys, ["_batch", version]).drop("_batch")


def write_catalog(df: DataFrame, path: str, by: str = "class_dir") -> None:
    """Full refresh: replace everything."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def refresh_classes(df: DataFrame, path: str, by: str = "class_dir") -> None:
    """Refresh of the classes in ``df`` only; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_catalog(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], version: str = "version",
                   by: str = "class_dir") -> None:
    """Upsert into the stored table by copy on write: only files that hold an updated key are written anew.

    The files are found by a semi-join of the table's keys with the updates, so
    nothing but their names reaches the driver.  The merged rows are staged next
    to the catalog and appended before the files they were read from are
    deleted.  If the job stops between the two, keys are there twice; the same
    upsert again finds both files and leaves the last version of each.
    """
    table = spark.read.parquet(path)
    columns = table.columns
    named = table.select(*keys, F.col("_metadata.file_path").alias("_file"))
    touched = [r[0] for r in named.join(updates.select(*keys).distinct(), list(keys), "left_semi").select("_file").distinct().collect()]
    reads = spark.read.option("basePath", path).schema(table.schema)
    old = reads.parquet(*touched).select(*columns) if touched else table.limit(0)
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    upsert(old, updates.select(*columns), keys, version).write.partitionBy(by).parquet(staged)
    spark.read.schema(table.schema).parquet(staged).write.mode("append").partitionBy(by).parquet(path)
    for name in touched:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
    spark.catalog.refreshByPath(path)


def read_catalog(spark: SparkSession, path: str, classes: Sequence[str] | None = None, by: str = "class_dir") -> DataFrame:
    """The table, or the partitions of some classes only."""
    df = spark.read.parquet(path)
    return df if classes is None else df.where(F.col(by).isin(list(classes)))
