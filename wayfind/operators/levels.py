"""Ranking by four levels of bundled vectors: roles, segments, layers, cortex.

A vector of -1, 0 and 1 is kept as two blocks of bits: which places are set, and
which of those are positive.  The dot product of two vectors is then a count of
bits.  The role level weighs most and is scored first; with a cosine of at most
1 on the other levels it bounds the whole score, and the finer levels of a
catalog row are read only where the bound reaches a query's k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wayfind.functions import vectors as V
from wayfind.operators.rowscore import Best, ordered_keys
from wayfind.operators.similarity import LEVEL_WEIGHTS

SLICE_ROWS = 2_048
MAX_QUERIES = 4_096
DIGITS = 6
SLACK = 1e-6


@dataclass(frozen=True)
class Shape:
    """Role columns by segment, and segments by layer; names are those of the encoded columns."""

    segments: dict[str, tuple[str, ...]]
    layers: dict[str, tuple[str, ...]]

    @property
    def roles(self) -> list[str]:
        return [r for roles in self.segments.values() for r in roles]

    def names(self) -> list[str]:
        return [*self.roles, *[f"s_{s}" for s in self.segments], *[f"l_{n}" for n in self.layers], "cortex"]


def bits(vector: Column) -> Column:
    """The places that are set, and of those the positive ones, as text of 0 and 1."""
    joined = lambda keep: F.array_join(F.transform(vector, keep), "")
    return F.struct(joined(lambda x: F.when(x != 0, "1").otherwise("0")).alias("set"), joined(lambda x: F.when(x > 0, "1").otherwise("0")).alias("up"))


def bundled(df: DataFrame, shape: Shape, seed: int, dim: int) -> DataFrame:
    """Bags of tokens per role become vectors, bundled upwards; every vector as bits."""
    up = lambda parts: V.majority(_sum([F.col(p) for p in parts])) if len(parts) > 1 else F.col(parts[0])
    kept = [c for c in df.columns if c not in shape.roles]
    out = df.select(*kept, *[V.bundle(seed, F.col(r), dim).alias(r) for r in shape.roles])
    out = out.withColumns({f"s_{s}": up(list(roles)) for s, roles in shape.segments.items()})
    out = out.withColumns({f"l_{n}": up([f"s_{s}" for s in segments]) for n, segments in shape.layers.items()})
    out = out.withColumn("cortex", up([f"l_{n}" for n in shape.layers]))
    return out.select(*kept, *[bits(F.col(n)).alias(n) for n in shape.names()])


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = V.add(total, p)
    return total


class Bits:
    """Vectors of one level: (rows x words) of set and of positive places, and the number of set places."""

    def __init__(self, column: pa.StructArray, dim: int):
        self.set = self._words(column.field("set"), dim)
        self.up = self._words(column.field("up"), dim)
        self.count = np.bitwise_count(self.set).sum(axis=1).astype(np.float64)

    @staticmethod
    def _words(texts: pa.Array, dim: int) -> np.ndarray:
        raw = "".join(texts.to_pylist()).encode()
        flags = (np.frombuffer(raw, np.uint8) == ord("1")).reshape(len(texts), dim)
        packed = np.packbits(flags, axis=1)
        whole = np.zeros((len(texts), -(-dim // 64) * 8), np.uint8)
        whole[:, :packed.shape[1]] = packed
        return whole.view(np.uint64)

    def take(self, rows: np.ndarray) -> Bits:
        out = Bits.__new__(Bits)
        out.set, out.up, out.count = self.set[rows], self.up[rows], self.count[rows]
        return out

    def cosines(self, queries: Bits) -> np.ndarray:
        """(rows x queries); 0 where a vector is empty."""
        dot = np.zeros((len(self.set), len(queries.set)))
        for w in range(self.set.shape[1]):
            both = self.set[:, None, w] & queries.set[None, :, w]
            dot += np.bitwise_count(both)
            dot -= 2.0 * np.bitwise_count((self.up[:, None, w] ^ queries.up[None, :, w]) & both)
        scale = np.sqrt(self.count)[:, None] * np.sqrt(queries.count)[None, :]
        return np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)


def _level(rows: dict[str, Bits], queries: dict[str, Bits], names: Sequence[str]) -> np.ndarray:
    return sum(rows[n].cosines(queries[n]) for n in names) / len(names)


def rank_levels(queries: DataFrame, catalog: DataFrame, shape: Shape, query_key: str, keys: Sequence[str], k: int, dim: int,
                max_queries: int = MAX_QUERIES) -> DataFrame:
    """Best ``k`` catalog rows per query: ``(query, keys..., score, rank)``; both sides from :func:`bundled`.

    All pairs are weighed, in the catalog's rows; equal scores rank by the keys.
    The queries are counted and must be few; more of them are asked in parts.
    """
    rows = queries.select(F.col(query_key).alias("_key"), *shape.names()).limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        raise ValueError(f"more than {max_queries} queries: rank them in parts")
    asked = [r["_key"] for r in rows]
    told = {n: [(r[n]["set"], r[n]["up"]) for r in rows] for n in shape.names()}
    roles, segments, layers = shape.roles, [f"s_{s}" for s in shape.segments], [f"l_{n}" for n in shape.layers]
    names = list(keys)
    fields = {f.name: f.dataType for f in catalog.schema.fields}
    schema = StructType([StructField("_q", LongType()), *[StructField(n, fields[n]) for n in names], StructField("raw", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("set", pa.string()), ("up", pa.string())])
        side = {n: Bits(pa.array([{"set": s, "up": u} for s, u in v], kind), dim) for n, v in told.items()}
        best, types = Best(len(asked), k, 2 * len(names)), []
        for batch in batches:
            types = [batch.column(n).type for n in names]
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = {n: Bits(part.column(n), dim) for n in roles}
                role = _level(found, side, roles)
                rest = sum(w for n, w in LEVEL_WEIGHTS.items() if n != "role")
                keep = np.flatnonzero((LEVEL_WEIGHTS["role"] * role + rest >= best.bound - SLACK).any(axis=1))
                if not len(keep):
                    continue
                few = part.take(pa.array(keep))
                finer = {n: Bits(few.column(n), dim) for n in [*segments, *layers, "cortex"]}
                raw = (
                    LEVEL_WEIGHTS["cortex"] * _level(finer, side, ["cortex"]) + LEVEL_WEIGHTS["layer"] * _level(finer, side, layers)
                    + LEVEL_WEIGHTS["segment"] * _level(finer, side, segments) + LEVEL_WEIGHTS["role"] * role[keep]
                )
                # Rounded before ranking: scores that are told as equal rank by their keys.
                best.offer(np.round(raw, DIGITS), ordered_keys(few, names))
        best.prune()
        if len(best.query):
            columns = [pa.array(value, t, mask=~there) for t, there, value in zip(types, best.keys[0::2], best.keys[1::2])]
            yield pa.RecordBatch.from_arrays([pa.array(best.query), *columns, pa.array(best.raw)], names=["_q", *names, "raw"])

    found = catalog.select(*names, *shape.names()).mapInArrow(run, schema)
    numbers = catalog.sparkSession.createDataFrame(
        list(enumerate(asked)), StructType([StructField("_q", LongType()), StructField("query", queries.schema[query_key].dataType)])
    )
    scored = found.join(F.broadcast(numbers), "_q").select("query", *names, F.col("raw").alias("score"))
    window = Window.partitionBy("query").orderBy(F.desc("score"), *names)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)

