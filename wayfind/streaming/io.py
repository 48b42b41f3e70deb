"""Run a stream over what is there, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive; the trigger size bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available with ``each(batch, number)``, then stop.

    A batch may be delivered again after a failure; ``each`` has to replace what
    it wrote for that number.
    """
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
        .awaitTermination()
    )


def replace_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a batch as its own partition: a repeat overwrites, never doubles."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
