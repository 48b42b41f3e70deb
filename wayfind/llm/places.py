"""Places of rows in the order of their key, also where one key holds most rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayfind.llm.common import stored


def placed(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` as a written table with ``name``: 0-based place among the rows of ``key`` by ``order``, nulls first.

    The rows are dealt out by ranges of key and order, so a key with many rows
    lies in several partitions; a number per row settles ties.  Rows count on
    inside a partition.  Only a partition's first key can go on from earlier
    ones, so at most two rows per partition carry counts over.
    """
    columns = df.columns
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    by = [key, *order, "_row"]
    schema = StructType([*rows.schema.fields, StructField("_run", LongType())])

    def run_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reached = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            new = np.ones(len(keys), dtype=bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            at = np.arange(len(keys))
            run = at - np.maximum.accumulate(np.where(new, at, 0))
            if keys[0].as_py() == last:
                first = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(keys)
                run[:first] += reached
            last, reached = keys[-1].as_py(), int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64())], names=[*batch.schema.names, "_run"])

    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    marked = stored(ranged.mapInArrow(run_places, schema).withColumn("_part", F.spark_partition_id()))
    runs = marked.groupBy(key, "_part").agg((F.max("_run") + 1).alias("_n"))
    many = runs.groupBy(key).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select(key)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.join(F.broadcast(many), key).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    out = marked.join(F.broadcast(carried), [key, "_part"], "left")
    return out.select(*columns, (F.col("_run") + F.coalesce("_carry", F.lit(0))).alias(name))
