"""Size-checked broadcast and ordered windows that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfind.config import checkpointed

BROADCAST_ROWS = 200_000


def rows_if_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of a table that fits ``max_rows``, else None.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def hold_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table computed once and kept, as a broadcast if it fits ``max_rows`` and the bound in bytes."""
    held = checkpointed(df)
    return F.broadcast(held) if is_small(held, max_rows) else held


def local_table(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """A few rows of the driver as a table that is read without a job; maps and the like go the usual way."""
    try:
        return spark.createDataFrame(pa.Table.from_pylist([_plain(r) for r in rows], schema=to_arrow_schema(schema)), schema)
    except (pa.ArrowInvalid, pa.ArrowTypeError, PySparkTypeError):
        return spark.createDataFrame([Row(**r) for r in rows], schema)


def _plain(value):
    """Rows inside rows as dictionaries."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


BROADCAST_BYTES = 128 << 20


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table fits both bounds, by a count of its first rows and of the text that they would make."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    few = df.limit(max_rows + 1).select(width.cast("bigint").alias("w")).agg(F.count("w").alias("n"), F.sum("w").alias("w")).first()
    return few["n"] <= max_rows and (few["w"] or 0) <= max_bytes


def checked_literals(df: DataFrame, max_rows: int) -> list | None:
    """The values of a table's only column, if they are at most ``max_rows``: for a list of literals in the plan."""
    rows = rows_if_small(df, max_rows)
    return None if rows is None else [r[0] for r in rows]


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = 5_000_000) -> DataFrame:
    """Keys that hold more than a task's share of the rows (fewer than 1000), and in ``_salts`` how many shares."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(share, total // 1000)
    return counts.where(F.col("_n") > limit).withColumn("_salts", F.ceil(F.col("_n") / limit).cast("int")).drop("_n")


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table: broadcast if its counted size allows it.

    For a larger lookup the hot keys of the big side are spread over salts, and
    only the lookup rows of those keys are repeated, once per salt.
    """
    on = list(on)
    if is_small(lookup, max_rows):
        return df.join(F.broadcast(lookup), on, how)
    hot = F.broadcast(hot_keys(df, on))
    salted = df.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), spread(F.col("_salts"), *df.columns)).otherwise(0)
    )
    salts = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    copies = lookup.join(hot, on, "left").withColumn("_salt", F.explode(salts))
    return salted.drop("_salts").join(copies.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def spread(salts: Column, *cols: str) -> Column:
    """A salt derived from the row itself, so that a re-run task repeats it."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), salts).cast("int")


class Ordered:
    """Window functions in the order of each key, also for a hot key.

    A plain window sends all rows of a key to one task.  Here the rows are
    counted per key first.  If no key holds more than a task's share, the plain
    window is used.  Otherwise the order of each hot key is cut at quantiles of
    ``split_on``, every piece is one window group, and the pieces' totals are
    carried forward through a small table (at most ~1000 pieces in all).

    ``split_on`` is a numeric expression that never decreases in the order.
    ``bound`` is a proven number of rows that no key exceeds; it saves the count.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], split_on: Column,
                 share: int = 5_000_000, bound: int | None = None):
        self.keys, self.order = list(keys), list(order)
        if bound is not None and bound <= share:
            self.df, self.group = df, self.keys
            return
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
        limit = max(share, (total or 0) // 1000)
        if (largest or 0) <= limit:
            self.df = df
            self.group = self.keys
        else:
            self.df = self._cut(df, counts.where(F.col("_n") > limit), split_on, -(-largest // limit))
            self.group = [*self.keys, "_piece"]

    def _cut(self, df: DataFrame, hot: DataFrame, split_on: Column, pieces: int) -> DataFrame:
        # Fewer than 1000 keys can exceed a thousandth of all rows.
        at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
        cuts = (
            df.withColumn("_at", split_on.cast("double"))
            .join(F.broadcast(hot.drop("_n")), self.keys)
            .groupBy(*self.keys)
            .agg(F.percentile_approx("_at", at, 10_000).alias("_cuts"))
        )
        # Collected, so that every later use sees the same cut points.
        fixed = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
        placed = df.join(F.broadcast(fixed), self.keys, "left")
        below = F.size(F.filter(F.col("_cuts"), lambda c: c < split_on.cast("double")))
        return placed.withColumn(
            "_piece", F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(below)
        ).drop("_cuts")

    def _window(self) -> Window:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def _carry(self, aggregate: Column, combine) -> DataFrame:
        totals = (
            self.df.where("_piece >= 0").groupBy(*self.group).agg(aggregate.alias("_total"))
        )
        across = Window.partitionBy(*self.keys).orderBy("_piece")
        return totals.select(*self.group, combine(across).alias("_carry"))

    def _apply(self, name: str, local: Column, aggregate: Column, combine, merge) -> Ordered:
        if self.group == self.keys:
            self.df = self.df.withColumn(name, local)
            return self
        carry = F.broadcast(self._carry(aggregate, combine))
        self.df = (
            self.df.withColumn(name, local)
            .join(carry, self.group, "left")
            .withColumn(name, merge(F.col(name), F.col("_carry")))
            .drop("_carry")
        )
        return self

    def row_number(self, name: str) -> Ordered:
        """1-based position in the key's order."""
        return self._apply(
            name,
            F.row_number().over(self._window()).cast("bigint"),
            F.count(F.lit(1)),
            lambda w: F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda here, before: here + F.coalesce(before, F.lit(0)),
        )

    def running(self, name: str, value: Column) -> Ordered:
        """Running sum, the current row included."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        return self._apply(
            name,
            F.sum(value).over(frame),
            F.sum(value),
            lambda w: F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda here, before: here + F.coalesce(before, F.lit(0)),
        )

    def previous(self, name: str, value: Column) -> Ordered:
        """The value of the row before; null at the start of a key."""
        packed = F.struct(value.alias("v"))
        return self._neighbour(name, F.lag(packed).over(self._window()), F.max_by(packed, self._position()), 1)

    def first(self, name: str, value: Column) -> Ordered:
        """The value of the first row of the key."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        packed = F.struct(value.alias("v"))
        self._apply(
            name, F.first(packed).over(frame), F.min_by(packed, self._position()),
            lambda w: F.first("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda here, before: F.coalesce(before, here),
        )
        self.df = self.df.withColumn(name, F.col(f"{name}.v"))
        return self

    def following(self, name: str, value: Column) -> Ordered:
        """The value of the row after; null at the end of a key."""
        packed = F.struct(value.alias("v"))
        return self._neighbour(name, F.lead(packed).over(self._window()), F.min_by(packed, self._position()), -1)

    def _position(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def _neighbour(self, name: str, local: Column, edge: Column, step: int) -> Ordered:
        self._apply(
            name, local, edge,
            lambda w: (F.lag("_total", 1) if step == 1 else F.lead("_total", 1)).over(w),
            lambda here, before: F.coalesce(here, before),
        )
        self.df = self.df.withColumn(name, F.col(f"{name}.v"))
        return self

    def with_column(self, name: str, value: Column) -> Ordered:
        self.df = self.df.withColumn(name, value)
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_piece")


def micros(col: str) -> Column:
    """A timestamp as a number for ``split_on``."""
    return F.unix_micros(F.col(col).cast("timestamp"))
