"""Exact duplicates by counting quotient filters that merge without loss.

Each task turns its texts' 64-bit fingerprints into a counting quotient filter:
a fingerprint is split into a quotient (its slot) and a remainder, and a slot
keeps its remainders in ascending order with their counts.  A filter is cut at
slot ranges (shards); shards of the same range from all tasks meet, and merge by
walking their sorted remainders.  Nothing is rounded, so the merged counts are
exact.  Texts whose fingerprint counts more than one go on to byte
verification; all others are known to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import free_name, give_back, held, small_side

SHARD_ROWS = 500_000
FLUSH_ROWS = 2_000_000


@dataclass
class CountingQuotientFilter:
    """Occupied slots, the length of each slot's run, and runs of (remainder, count)."""

    quotient_bits: int
    slots: np.ndarray
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """A filter of 64-bit fingerprints; ``counts`` weighs them (default 1 each)."""
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        first = np.ones(len(ordered), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        weight = np.ones(len(ordered), dtype=np.int64) if counts is None else counts[order]
        at = np.flatnonzero(first)
        total = np.add.reduceat(weight, at) if len(at) else np.zeros(0, dtype=np.int64)
        distinct = ordered[at]
        rest = np.uint64(64 - quotient_bits)
        slots, runs = np.unique(distinct >> rest, return_counts=True)
        remainder = distinct & np.uint64((1 << (64 - quotient_bits)) - 1)
        return cls(quotient_bits, slots, runs, remainder, total)

    def fingerprints(self) -> np.ndarray:
        """Slots and remainders put together again, ascending."""
        return (np.repeat(self.slots, self.runs) << np.uint64(64 - self.quotient_bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters in one: the walk over sorted remainders is a stable merge of two sorted runs."""
        both = np.concatenate([self.fingerprints(), other.fingerprints()])
        return CountingQuotientFilter.of(both, self.quotient_bits, np.concatenate([self.counts, other.counts]))

    def shard(self, low: int, high: int) -> CountingQuotientFilter:
        """The slots from ``low`` up to ``high``, the end excluded."""
        a, b = np.searchsorted(self.slots, np.array([low, high], dtype=np.uint64))
        ends = np.concatenate([[0], np.cumsum(self.runs)])
        return CountingQuotientFilter(
            self.quotient_bits, self.slots[a:b], self.runs[a:b],
            self.remainders[ends[a]:ends[b]], self.counts[ends[a]:ends[b]],
        )

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (self.slots.tobytes(), self.runs.astype(np.int32).tobytes(), self.remainders.tobytes(), self.counts.tobytes())

    @classmethod
    def from_row(cls, quotient_bits: int, row: tuple) -> CountingQuotientFilter:
        slots, runs, remainders, counts = row
        return cls(
            quotient_bits, np.frombuffer(slots, np.uint64), np.frombuffer(runs, np.int32).astype(np.int64),
            np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64),
        )


def repeated_fingerprints(prints: DataFrame, rows: int, quotient_bits: int = 20) -> DataFrame:
    """Fingerprints (``print`` bigint) that count more than one, with their counts.

    ``rows`` sizes the shards only: about ``SHARD_ROWS`` distinct fingerprints
    each, whatever the input.  A fingerprint's copies are counted before the
    shuffle, so a hot text adds one remainder per task.
    """
    shard_bits = min(quotient_bits, max(4, math.ceil(math.log2(max(1, rows / SHARD_ROWS))) + 1))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                whole = CountingQuotientFilter.of(np.concatenate(kept), quotient_bits)
                width = 1 << (quotient_bits - shard_bits)
                out = []
                for k in range(1 << shard_bits):
                    part = whole.shard(k * width, (k + 1) * width)
                    if len(part.slots):
                        out.append((k, *part.to_row()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))],
                    names=["shard", "slots", "runs", "remainders", "counts"],
                )
                kept.clear()

        for batch in batches:
            kept.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, kept)) >= FLUSH_ROWS:
                yield from flush()
        yield from flush()
        give_back()

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Merges as they come, two of like size at a time: never more than the shard's distinct fingerprints.
        stack: list[CountingQuotientFilter] = []
        for batch in parts:
            for row in batch.select(["slots", "runs", "remainders", "counts"]).to_pylist():
                stack.append(CountingQuotientFilter.from_row(quotient_bits, tuple(row.values())))
                while len(stack) > 1 and len(stack[-2].counts) <= 2 * len(stack[-1].counts):
                    last = stack.pop()
                    stack.append(stack.pop().merge(last))
        while len(stack) > 1:
            last = stack.pop()
            stack.append(stack.pop().merge(last))
        for whole in stack:
            more = whole.counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole.fingerprints()[more].view(np.int64)), pa.array(whole.counts[more])], names=["print", "n"]
            )
        give_back()

    shards = prints.select("print").mapInArrow(
        build, "shard int, slots binary, runs binary, remainders binary, counts binary"
    )
    return shards.groupBy("shard").applyInArrow(merge, "print bigint, n bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; null counts as the empty text.  The
    largest id of a group stays.  Repeated rows with the same id are copies of
    each other: each gets its row, and all rows with the kept id are ``kept``.
    A null id never beats another id; a group of null ids only has a null
    ``keep_id`` and its rows are kept.  An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    prints = base.select(F.xxhash64("body").alias("print"))
    suspects = held(repeated_fingerprints(prints, prints.count()).select("print"))
    hashed = base.select("id", F.xxhash64("body").alias("print"), F.sha2("body", 256).alias("sha"))
    # Byte verification: the grouping key is the text itself, combined before the shuffle.
    groups = (
        base.withColumn("print", F.xxhash64("body"))
        .join(small_side(suspects), "print", "left_semi")
        .groupBy("print", "body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("print", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")
    )
    joined = hashed.join(small_side(held(groups)), ["print", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row per text, all columns as they came.

    Texts as in ``exact_groups``; of several rows with the kept id and the same
    text one stays.
    """
    flag, at = free_name(docs, "_kept"), free_name(docs, "_print")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    suspects = held(repeated_fingerprints(docs.select(F.xxhash64(body).alias("print")), docs.count()))
    suspects = suspects.select(F.col("print").alias(at), F.lit(True).alias(flag))
    marked = docs.withColumn(at, F.xxhash64(body)).join(small_side(suspects), at, "left")
    alone = marked.where(F.col(flag).isNull()).drop(at, flag)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    copies = (
        marked.where(F.col(flag)).groupBy(body.alias("_body"))
        .agg(F.max_by(row, F.struct(F.col(f"`{id_col}`"), F.xxhash64(row))).alias("_row")).select("_row.*")
    )
    return alone.unionByName(copies)
