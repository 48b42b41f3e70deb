"""Exact top-k of a large catalog for a counted set of queries, scored inside the catalog's rows.

The queries become one table of token -> query numbers per role, which every
task holds.  A catalog row counts its hits for all queries at once, so no row
per shared token and no pair of keys is ever shuffled.  A task keeps, per
query, what can still be among its best ``k``; only that leaves the task.

Scores are made in two steps.  The rare part of a role's tokens is counted
first; with the greatest contribution that the common tokens could add, it
bounds the score.  The common tokens are counted only for rows of which some
query's bound reaches its k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from wayfind.operators.features import Encoding
from wayfind.operators.scale import local_table

MAX_QUERIES = 4_096
MAX_POSTINGS = 200_000
SLICE_ROWS = 1_024
CELLS = 4_000_000
PART = 256
# Scores are compared after rounding to nine digits: what lies this close to a bound may still pass it.
SLACK = 2e-9
COMMON_SHARE = 0.25


@dataclass
class RoleIndex:
    """The queries' bags of one role: tokens by code, a row of flags per token, and the bag sizes."""

    tokens: pa.Array
    flags: np.ndarray
    sizes: np.ndarray


@dataclass
class QuerySide:
    """All queries of a comparison, numbered: categories as text (None: absent) and one index per bag role."""

    keys: list
    categories: dict[str, list]
    roles: dict[str, RoleIndex]

    def part(self, a: int, b: int) -> QuerySide:
        roles = {}
        for name, index in self.roles.items():
            flags = index.flags[:, a:b]
            used = flags.any(axis=1)
            roles[name] = RoleIndex(index.tokens.filter(pa.array(used)), np.ascontiguousarray(flags[used]), index.sizes[a:b])
        return QuerySide(self.keys[a:b], {n: v[a:b] for n, v in self.categories.items()}, roles)


def query_side(queries: DataFrame, key: str, encoding: Encoding, max_queries: int = MAX_QUERIES, max_postings: int = MAX_POSTINGS) -> QuerySide | None:
    """The encoded queries, if they are few by count; else None.

    No more than ``max_queries`` rows are collected, and those only after their
    tokens have been counted.
    """
    held = queries.select(F.col(key).alias("_key"), *[r.name for r in encoding.roles])
    size = sum((F.coalesce(F.size(r.name), F.lit(0)) for r in encoding.bags), F.lit(0))
    counted = held.select(size.alias("n")).limit(max_queries + 1).agg(F.count("n").alias("rows"), F.sum("n").alias("tokens")).first()
    if counted["rows"] > max_queries or (counted["tokens"] or 0) > max_postings:
        return None
    rows = held.collect()
    roles = {}
    for r in encoding.bags:
        number = {w: k for k, w in enumerate(sorted({w for row in rows for w in row[r.name] or ()}))}
        flags = np.zeros((len(number), len(rows)), dtype=np.uint8)
        for q, row in enumerate(rows):
            for w in row[r.name] or ():
                flags[number[w], q] = 1
        sizes = np.array([np.nan if row[r.name] is None else len(row[r.name]) for row in rows], dtype=np.float64)
        roles[r.name] = RoleIndex(pa.array(list(number), pa.string()), flags, sizes)
    return QuerySide([row["_key"] for row in rows], {r.name: [row[r.name] for row in rows] for r in encoding.categories}, roles)


def _hits(bags: pa.ListArray, index: RoleIndex) -> tuple[np.ndarray, np.ndarray]:
    """Row and token code of every item of ``bags`` that the index holds."""
    offsets = bags.offsets.to_numpy()
    flat = bags.values.slice(offsets[0], offsets[-1] - offsets[0])
    codes = pc.index_in(flat, value_set=index.tokens)
    found = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    row = np.searchsorted(offsets - offsets[0], found, side="right") - 1
    return row, codes.fill_null(0).to_numpy(zero_copy_only=False)[found]


def _counts(row: np.ndarray, code: np.ndarray, flags: np.ndarray, rows: int) -> np.ndarray:
    """Shared tokens (rows x queries) of hits in row order."""
    out = np.zeros((rows, flags.shape[1]), dtype=np.int32)
    step = max(1, CELLS // max(1, flags.shape[1]))
    for a in range(0, len(row), step):
        r = row[a:a + step]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[first]] += np.add.reduceat(flags[code[a:a + step]], first, axis=0, dtype=np.int32)
    return out


def _mean(items: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Weighted mean over what is present (not NaN), summed in the order given; NaN where nothing is."""
    total, weight = 0.0, 0.0
    for s, w in items:
        there = ~np.isnan(s)
        total = total + np.where(there, s * w, 0.0)
        weight = weight + np.where(there, w, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def layered(sims: dict[str, np.ndarray], encoding: Encoding) -> np.ndarray:
    """The layered score of similarity arrays, operation by operation as the expression of the same name."""
    layers = []
    for layer in encoding.layers:
        roles = [r for r in encoding.roles if r.layer == layer]
        layers.append((_mean([(sims[r.name], r.weight) for r in roles]), roles[0].layer_weight))
    return np.nan_to_num(_mean(layers), nan=0.0)


class Best:
    """What can still be among the best ``k`` of each query: numbers of queries, raw scores and ordered keys."""

    def __init__(self, queries: int, k: int, keys: int):
        self.k, self.queries = k, queries
        self.query = np.zeros(0, np.int64)
        self.raw = np.zeros(0, np.float64)
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(keys)]
        self.bound = np.full(queries, -np.inf)
        self.full = np.full(queries, -1, np.int64)
        self.waiting: list[tuple] = []
        self.held = 0

    def offer(self, raw: np.ndarray, keys: list[np.ndarray]) -> None:
        """Scores (rows x queries) of rows with these keys."""
        row, q = np.nonzero(raw >= self.bound - SLACK)
        value = raw[row, q]
        # Of rows with one raw score no more than k can count, the first by key.
        tied = np.flatnonzero((value == self.bound[q]) & (self.full[q] >= 0))
        if len(tied):
            last = self.full[q[tied]]
            after, same = np.zeros(len(tied), bool), np.ones(len(tied), bool)
            for mine, held in zip(keys, self.keys):
                a, b = mine[row[tied]], held[last]
                after |= same & (a > b)
                same &= a == b
            keep = np.ones(len(row), bool)
            keep[tied[after]] = False
            row, q, value = row[keep], q[keep], value[keep]
        if len(row):
            self.waiting.append((q, value, [key[row] for key in keys]))
            self.held += len(row)
        if self.held > 4 * self.k * self.queries + 100_000 or np.isneginf(self.bound).any():
            self.prune()

    def prune(self) -> None:
        if not self.waiting:
            return
        query = np.concatenate([self.query, *[w[0] for w in self.waiting]])
        raw = np.concatenate([self.raw, *[w[1] for w in self.waiting]])
        keys = [np.concatenate([held, *[w[2][n] for w in self.waiting]]) if len(held) else np.concatenate([w[2][n] for w in self.waiting]) for n, held in enumerate(self.keys)]
        self.waiting, self.held = [], 0
        order = np.lexsort([*reversed(keys), -raw, query])
        query, raw, keys = query[order], raw[order], [key[order] for key in keys]
        place = _place(query)
        same = np.concatenate([[True], (query[1:] != query[:-1]) | (raw[1:] != raw[:-1])])
        group = np.arange(len(raw)) - np.maximum.accumulate(np.where(same, np.arange(len(raw)), 0))
        kth = np.flatnonzero(place == self.k - 1)
        self.bound[query[kth]] = raw[kth]
        keep = (group < self.k) & (raw >= self.bound[query] - SLACK)
        self.query, self.raw, self.keys = query[keep], raw[keep], [key[keep] for key in keys]
        at = np.flatnonzero(self.raw == self.bound[self.query])
        self.full[:] = -1
        last = at[group[keep][at] == self.k - 1]
        self.full[self.query[last]] = last


def _place(query: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], query[1:] != query[:-1]])
    return np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))


class Scorer:
    """Scores of slices of catalog rows for all queries; learns which tokens are common from the rows it sees."""

    def __init__(self, side: QuerySide, encoding: Encoding):
        self.side, self.encoding = side, encoding
        self.seen = 0
        self.met = {name: np.zeros(len(index.tokens), np.int64) for name, index in side.roles.items()}
        self.values = {r.name: pa.array(sorted({v for v in side.categories[r.name] if v is not None}), pa.string()) for r in encoding.categories}
        self.coded = {}
        for r in encoding.categories:
            code = {v: k for k, v in enumerate(self.values[r.name].to_pylist())}
            self.coded[r.name] = np.array([-1 if v is None else code[v] for v in side.categories[r.name]])

    def _categories(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        sims = {}
        for r in self.encoding.categories:
            column = batch.column(r.name)
            code = pc.index_in(column, value_set=self.values[r.name]).fill_null(-2).to_numpy(zero_copy_only=False)
            sim = (code[:, None] == self.coded[r.name][None, :]).astype(np.float64)
            absent = column.is_null().to_numpy(zero_copy_only=False)[:, None] | (self.coded[r.name] < 0)[None, :]
            sims[r.name] = np.where(absent, np.nan, sim)
        return sims

    def scores(self, batch: pa.RecordBatch, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that some query's bound lets through, and their exact scores."""
        rows = batch.num_rows
        sims = self._categories(batch)
        sizes, hits = {}, {}
        for r in self.encoding.bags:
            bags = batch.column(r.name)
            sizes[r.name] = np.where(bags.is_null().to_numpy(zero_copy_only=False), np.nan, np.diff(bags.offsets.to_numpy()).astype(np.float64))
            hits[r.name] = _hits(bags, self.side.roles[r.name])
        common = {name: met > COMMON_SHARE * max(self.seen, 1) for name, met in self.met.items()}
        self.seen += rows
        for name, (_, code) in hits.items():
            self.met[name] += np.bincount(code, minlength=len(self.met[name]))
        keep = np.arange(rows)
        if np.isfinite(bound).all() and any(c.any() for c in common.values()):
            upper = dict(sims)
            for r in self.encoding.bags:
                row, code = hits[r.name]
                index, often = self.side.roles[r.name], common[r.name]
                rare = ~often[code]
                shared = _counts(row[rare], code[rare], index.flags, rows)
                # The row's common tokens, and no more of them than the query has, may all be shared.
                could = np.minimum(np.bincount(row[~rare], minlength=rows)[:, None], index.flags[often].sum(axis=0, dtype=np.int32)[None, :])
                upper[r.name] = self._cosine(shared + could, sizes[r.name], index.sizes)
            keep = np.flatnonzero((layered(upper, self.encoding) >= bound - SLACK).any(axis=1))
        place = np.full(rows, -1)
        place[keep] = np.arange(len(keep))
        exact = {name: s[keep] for name, s in sims.items()}
        for r in self.encoding.bags:
            row, code = hits[r.name]
            inside = place[row] >= 0
            shared = _counts(place[row[inside]], code[inside], self.side.roles[r.name].flags, len(keep))
            exact[r.name] = self._cosine(shared, sizes[r.name][keep], self.side.roles[r.name].sizes)
        return keep, layered(exact, self.encoding)

    @staticmethod
    def _cosine(shared: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return shared / np.sqrt(queries[None, :] * rows[:, None])


def ordered_keys(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    """Key columns as arrays that compare as Spark orders them, nulls first."""
    out = []
    for name in names:
        column = batch.column(name)
        out.append(column.is_valid().to_numpy(zero_copy_only=False))
        if pa.types.is_integer(column.type):
            out.append(column.fill_null(0).to_numpy(zero_copy_only=False))
        else:
            out.append(np.array(column.fill_null("").to_pylist(), dtype=str) if len(column) else np.zeros(0, "U1"))
    return out


def raw_top_k(side: QuerySide, catalog: DataFrame, encoding: Encoding, keys: Sequence[str], k: int, query_type, block: int = PART) -> DataFrame:
    """(query, keys..., raw): each task's rows that can be among a query's best ``k``.

    The true best by rounded score and key are among them.
    """
    fields = {f.name: f.dataType for f in catalog.schema.fields}
    schema = StructType([StructField("_q", LongType()), *[StructField(n, fields[n]) for n in keys], StructField("raw", DoubleType())])
    names, width = list(keys), len(side.keys)
    parts = [(a, side.part(a, min(a + block, width))) for a in range(0, width, block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(a, Scorer(part, encoding), Best(len(part.keys), k, 2 * len(names))) for a, part in parts]
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(n).type for n in names]
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                ordered = ordered_keys(piece, names)
                for _, scorer, best in held:
                    keep, raw = scorer.scores(piece, best.bound)
                    best.offer(raw, [key[keep] for key in ordered])
        for a, _, best in held:
            best.prune()
            if len(best.query):
                columns = [
                    pa.array(value, kind, mask=~there) for kind, there, value in zip(types, best.keys[0::2], best.keys[1::2])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(best.query + a), *columns, pa.array(best.raw)], names=["_q", *names, "raw"])

    needed = catalog.select(*names, *[r.name for r in encoding.roles])
    found = needed.mapInArrow(run, schema)
    # Query numbers become keys again: as many rows as there are queries.
    numbers = local_table(
        catalog.sparkSession, [{"_q": n, "query": key} for n, key in enumerate(side.keys)],
        StructType([StructField("_q", LongType()), StructField("query", query_type)]),
    )
    return found.join(F.broadcast(numbers), "_q").select("query", *names, "raw")


def best_entries(side: QuerySide, rows: DataFrame, encoding: Encoding, key: str, k: int, entry_type) -> DataFrame:
    """Best ``k`` entries of the counted ``side`` for every row: ``(query, candidate, score, rank)``.

    Each row is scored against all entries by itself and ranks them in place:
    nothing is shuffled, however many rows there are.
    """
    order = sorted(range(len(side.keys)), key=lambda n: (side.keys[n] is not None, _comparable(side.keys[n])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("query", fields[key]), StructField("raw", ArrayType(DoubleType())), StructField("n", ArrayType(LongType()))])
    most = min(k, len(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(side, encoding)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                _, raw = scorer.scores(piece, np.full(len(order), -np.inf))
                kth = -np.partition(-raw, most - 1, axis=1)[:, most - 1]
                row, entry = np.nonzero(raw >= kth[:, None] - SLACK)
                value, n = raw[row, entry], place[entry]
                sort = np.lexsort([n, -value, row])
                row, value, n = row[sort], value[sort], n[sort]
                same = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
                group = np.arange(len(row)) - np.maximum.accumulate(np.where(same, np.arange(len(row)), 0))
                row, value, n = row[group < k], value[group < k], n[group < k]
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key), pa.ListArray.from_arrays(ends, pa.array(value)), pa.ListArray.from_arrays(ends, pa.array(n))],
                    names=["query", "raw", "n"],
                )

    entries = local_table(
        rows.sparkSession, [{"n": int(place[n]), "candidate": value} for n, value in enumerate(side.keys)],
        StructType([StructField("n", LongType()), StructField("candidate", entry_type)]),
    )
    if not most:
        nothing = StructType([StructField("query", fields[key]), StructField("candidate", entry_type), StructField("score", DoubleType()), StructField("rank", IntegerType())])
        return rows.sparkSession.createDataFrame([], nothing)
    found = rows.select(key, *[r.name for r in encoding.roles]).mapInArrow(run, schema)
    scored = F.zip_with("raw", "n", lambda s, n: F.struct((-F.round(s, 9)).alias("down"), n.alias("n")))
    ranked = found.select("query", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("at", "s"))
    return ranked.select("query", (-F.col("s.down")).alias("score"), F.col("s.n").alias("n"), (F.col("at") + 1).alias("rank")).join(
        F.broadcast(entries), "n"
    ).select("query", "candidate", "score", "rank")


def pairs_above(side: QuerySide, rows: DataFrame, encoding: Encoding, key: str, threshold: float, query_type) -> DataFrame:
    """``(query, candidate, score)`` of all pairs with a score of ``threshold`` or more: a similarity join without a shuffle.

    Each row is held against all counted queries by itself and gives away only
    the pairs that reach the threshold.
    """
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("_q", LongType()), StructField("candidate", fields[key]), StructField("raw", DoubleType())])
    width = len(side.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(a, Scorer(side.part(a, min(a + PART, width)), encoding)) for a in range(0, width, PART)]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                for a, scorer in parts:
                    keep, raw = scorer.scores(piece, np.full(len(scorer.side.keys), threshold))
                    row, q = np.nonzero(raw >= threshold - SLACK)
                    if len(row):
                        candidate = piece.column(key).take(pa.array(keep[row]))
                        yield pa.RecordBatch.from_arrays([pa.array(q + a), candidate, pa.array(raw[row, q])], names=["_q", "candidate", "raw"])

    numbers = local_table(
        rows.sparkSession, [{"_q": n, "query": value} for n, value in enumerate(side.keys)],
        StructType([StructField("_q", LongType()), StructField("query", query_type)]),
    )
    found = rows.select(key, *[r.name for r in encoding.roles]).mapInArrow(run, schema)
    scored = found.join(F.broadcast(numbers), "_q").select("query", "candidate", F.round("raw", 9).alias("score"))
    return scored.where(F.col("score") >= threshold)


def _comparable(value):
    return value.encode() if isinstance(value, str) else 0 if value is None else value
