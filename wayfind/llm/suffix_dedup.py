"""Long passages that repeat across documents, by logarithmic families of sorted stretches.

A document is sampled where every 50-byte string agrees on one place: the
leftmost smallest hash of a 24-byte run inside the string is its anchor.
Strings with one anchor lie next to each other; they make a stretch of 50 to 76
bytes, which a hash of its content names.  A batch of documents becomes an array
of its stretches, sorted by name; arrays are cut at ranges of the anchors'
hashes (shards), so that each shard holds an index of its own.  The index is a
logarithmic family: a new batch is looked up in each level, by equality of names,
the larger document id of a stretch that both have is marked, and levels of
like size merge, so each stretch moves through few merges.  There is no suffix
order and no match length: a stretch that both have is the match.

A stretch that an earlier document has whole is repeated whole.  Where an anchor
has several stretches (the ends of a match), only the first document of each
can hold strings that another has too; if two of them agree for half of what a
string has beside the anchor, their strings go through a second family one by
one.  Fingerprints have 64 bits; bytes are compared by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import free_name, give_back, held, mixed, slices, small_side, stored

LENGTH = 50
GRAM = 24
PLACES = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
FLUSH = 500_000
SHARD_STRETCHES = 1_500_000
SLICE_BYTES = 300_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _M[0])


@dataclass
class Stretches:
    """Runs of strings with one anchor: row, first and last string start, fingerprint of the anchor, name, sides."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    side: np.ndarray  # two small hashes: the HALF bytes left and right of the anchor (0: the stretch has fewer)
    strings: np.ndarray  # a hash of the 50 bytes from each place


def stretches(raw: list[bytes]) -> tuple[Stretches, np.ndarray]:
    """The stretches of some texts laid end to end, and where each text starts (and the end)."""
    begins = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return Stretches(empty, empty, empty, *[empty.view(np.uint64)] * 2, empty.astype(np.uint16), empty.view(np.uint64)), begins
    h1 = _BYTES[data]
    h2 = h1[:-1] * _M[0] + h1[1:]
    h4 = h2[:-2] * _M[1] + h2[2:]
    h8 = h4[:-4] * _M[2] + h4[4:]
    h16 = h8[:-8] * _M[3] + h8[8:]
    gram = h16[:n - GRAM + 1] * _M[4] + h8[16:]
    gram ^= gram >> np.uint64(31)
    gram *= _M[5]
    gram ^= gram >> np.uint64(33)
    # leftmost smallest of PLACES neighbours, by doubling
    low, at = gram, np.arange(len(gram), dtype=np.int32)
    width = 1
    while width < PLACES:
        move = min(width, PLACES - width)
        right = low[move:] < low[:-move]
        at = np.where(right, at[move:], at[:-move])
        low = np.minimum(low[move:], low[:-move])
        width += move
    whole = np.ones(len(at), dtype=bool)  # strings that end in the text they start in
    for end in begins[1:-1]:
        whole[max(0, end - LENGTH + 1):end] = False
    start = np.flatnonzero(whole)
    if not len(start):
        return Stretches(empty, empty, empty, *[empty.view(np.uint64)] * 2, empty.astype(np.uint16), empty.view(np.uint64)), begins
    anchor = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    first, last = start[head], start[np.concatenate([head[1:] - 1, [len(start) - 1]])]
    strings = gram[:n - LENGTH + 1] * _M[1] + gram[GRAM:n - GRAM + 1 - (LENGTH - 2 * GRAM)] * _M[2] + gram[LENGTH - GRAM:]
    fingerprint = gram[anchor[head]]
    name = mixed(strings[first] * _M[3] + mixed(strings[last] + (last - first).astype(np.uint64) * _M[4]) + fingerprint)
    row = np.searchsorted(begins, first, side="right") - 1
    # HALF (13) bytes: 8, 4 and 1
    place = anchor[head].astype(np.int64)

    def small(begin: np.ndarray, there: np.ndarray) -> np.ndarray:
        begin = np.where(there, begin, 0)
        full = mixed(h8[begin] * _M[3] + h4[begin + 8] * _M[4] + h1[begin + 12])
        return np.where(there, 1 + (full >> np.uint64(32)) % np.uint64(255), 0).astype(np.uint16)

    side = small(place - HALF, place - first >= HALF) * np.uint16(256) + small(place + GRAM, last + LENGTH - place - GRAM >= HALF)
    return Stretches(row, first, last, fingerprint, name, side, strings), begins


Run = tuple[np.ndarray, ...]


class LevelFamily:
    """Levels of (name, anchor, side, first document), each sorted by name; a name is in one level only."""

    def __init__(self):
        self.levels: list[Run] = []

    def add(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Look up a batch, sorted by name and without repeats, in all levels.

        Returns (document, name) of all that turn out to repeat an earlier
        document, in the batch or in a level.
        """
        docs, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for level in self.levels:
            if not len(run[0]):
                break
            at = np.minimum(np.searchsorted(level[0], run[0]), len(level[0]) - 1)
            same = level[0][at] == run[0]
            there, mine = level[3][at[same]], run[3][same]
            docs.append(np.maximum(there, mine)[there != mine])
            names.append(run[0][same][there != mine])
            level[3][at[same]] = np.minimum(there, mine)
            run = tuple(x[~same] for x in run)
        if len(run[0]):
            self.levels.append((*run[:3], run[3].copy()))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            merged = [np.concatenate(x) for x in zip(self.levels.pop(), self.levels.pop())]
            order = np.argsort(merged[0], kind="stable")  # two sorted runs
            self.levels.append(tuple(x[order] for x in merged))
        return np.concatenate(docs), np.concatenate(names)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, name) of stretches with the anchor of another, and a side like it."""
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        name, anchor, side, doc = (np.concatenate(x) for x in zip(*self.levels))
        chosen = np.zeros(len(name), dtype=bool)
        for half in (side >> 8, side & 255):
            key = anchor.astype(np.uint64) * np.uint64(256) + half
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            equal = (ordered[1:] == ordered[:-1]) & (half[order][1:] > 0)
            shared = np.zeros(len(ordered), dtype=bool)
            shared[1:] |= equal
            shared[:-1] |= equal
            chosen[order[shared]] = True
        return doc[chosen], name[chosen]


def first_of_each(run: Run) -> tuple[Run, np.ndarray, np.ndarray]:
    """The run by name with the least document of each; and (document, name) of the others."""
    order = np.lexsort((run[3], run[0]))
    run = tuple(x[order] for x in run)
    name, doc = run[0], run[3]
    new = np.ones(len(name), dtype=bool)
    new[1:] = name[1:] != name[:-1]
    other = ~new
    if len(name):
        other &= doc != doc[np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))]
        other[1:] &= new[1:] | (doc[1:] != doc[:-1])
    return tuple(x[new] for x in run), doc[other], name[other]


def by_document(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Distinct documents, and the names of each as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, raw = doc[order], name[order].tobytes()
    ids, begin = np.unique(doc, return_index=True)
    return ids, [raw[8 * a:8 * b] for a, b in zip(begin, np.append(begin[1:], len(doc)))]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: high bytes repeat."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


SHARDED = "shard int, name binary, anchor binary, side binary, doc binary, again_doc binary, again_name binary"
FOUND = "doc bigint, kind int, names binary"


def repeats(docs: DataFrame, entries, shard_bits: int, keep_ends: bool) -> DataFrame:
    """Rows (doc, kind, names): kind 0 names what an earlier document has too, kind 1 the ends of matches.

    ``entries`` makes runs of (name, anchor, side, doc) of a pandas batch.  A
    task keeps the least document of each name and marks the others by itself,
    so what is frequent reaches its shard once per task.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[Run] = []

        def flush() -> Iterator[pd.DataFrame]:
            run, again_doc, again_name = first_of_each(tuple(np.concatenate(x) for x in zip(*runs)))
            runs.clear()
            shard = (mixed(run[1]) >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(run[0]), np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange((1 << shard_bits) + 1))
            out = []
            spread = int(run[0][0] % np.uint64(1 << shard_bits)) if len(run[0]) else 0
            for k in range(1 << shard_bits):
                part = order[cut[k]:cut[k + 1]]
                mine = k == spread and len(again_doc)
                if len(part) or mine:
                    low = (run[1][part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    out.append((
                        k, run[0][part].tobytes(), low.tobytes() if keep_ends else b"", run[2][part].tobytes() if keep_ends else b"",
                        _planes(run[3][part]), _planes(again_doc) if mine else None, again_name.tobytes() if mine else None,
                    ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHARDED.split(", ")])

        for batch in batches:
            for run in entries(batch):
                runs.append(run)
                if sum(len(r[0]) for r in runs) >= FLUSH:
                    yield from flush()
        if runs:
            yield from flush()
        give_back()

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily()

        def told(doc: np.ndarray, name: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            if len(doc):
                ids, names = by_document(doc, name)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), kind, np.int32)), pa.array(names, pa.binary())], names=["doc", "kind", "names"])

        for batch in parts:
            for row in batch.to_pylist():
                name = np.frombuffer(row["name"], np.uint64)
                if len(name):
                    doc = _unplaned(row["doc"], np.int64)
                    anchor = np.frombuffer(row["anchor"], np.uint32) if keep_ends else np.zeros(len(name), np.uint32)
                    side = np.frombuffer(row["side"], np.uint16) if keep_ends else np.zeros(len(name), np.uint16)
                    yield from told(*family.add((name, anchor, side, doc)), 0)
                if row["again_doc"] is not None:
                    yield from told(_unplaned(row["again_doc"], np.int64), np.frombuffer(row["again_name"], np.uint64), 0)
        if keep_ends:
            yield from told(*family.ends(), 1)
        give_back()

    return docs.mapInPandas(build, SHARDED).groupBy("shard").applyInArrow(scan, FOUND)


def _joined(names: list) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.uint64) if names is not None and len(names) else np.zeros(0, np.uint64)


def _keys(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One number for (row of a slice, name)."""
    return mixed(name + mixed(row.astype(np.uint64) + np.uint64(1)))


def _in_rows(row: np.ndarray, name: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Which (row, name) are among the names wanted of that row."""
    theirs = _keys(np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted) if wanted else np.zeros(0, np.uint64))
    return np.isin(_keys(row, name), theirs)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place from first to last, and the number of its range."""
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def _cut(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    for a, b in slices(map(len, batch["body"]), SLICE_BYTES, 20_000):
        part = batch.iloc[a:b]
        yield part, [t.encode() for t in part["body"]]


def all_stretches(batch: pd.DataFrame) -> Iterator[Run]:
    for part, raw in _cut(batch):
        s, _ = stretches(raw)
        yield s.name, s.anchor, s.side, part["id"].to_numpy(np.int64)[s.row]


def strings_of_ends(batch: pd.DataFrame) -> Iterator[Run]:
    """The strings of the stretches named in column ``ends``, by their own hash."""
    for part, raw in _cut(batch):
        s, _ = stretches(raw)
        hit = np.flatnonzero(_in_rows(s.row, s.name, [_joined(x) for x in part["ends"]]))
        place, which = _spread(s.first[hit], s.last[hit])
        string = mixed(s.strings[place])
        yield string, string, np.zeros(len(string), np.uint16), part["id"].to_numpy(np.int64)[s.row[hit][which]]


def cut_out(raw: list[bytes], whole: list[np.ndarray], single: list[np.ndarray]) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, removed runs, SHA-256 of the rest) of texts with the repeated stretches and strings named."""
    s, begins = stretches(raw)
    starts = np.zeros(begins[-1] + 1, dtype=bool)
    hit = _in_rows(s.row, s.name, whole)
    starts[_spread(s.first[hit], s.last[hit])[0]] = True
    some = np.array([len(x) > 0 for x in single], dtype=bool)
    rest = np.flatnonzero(some[s.row] & ~hit)
    place, which = _spread(s.first[rest], s.last[rest])
    found = _in_rows(s.row[rest][which], mixed(s.strings[place]), single)
    starts[place[found]] = True
    # a byte goes when a marked string starts at most LENGTH - 1 before it; strings end in their text
    edge = np.zeros(begins[-1] + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    out = []
    for text, a, b in zip(raw, begins, begins[1:]):
        here = gone[a:b]
        runs = int(here[:1].sum()) + int((here[1:] & ~here[:-1]).sum())
        kept = np.frombuffer(text, np.uint8)[~here].tobytes()
        out.append((len(text), int(here.sum()), runs, kept))
    return out


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept "


def _cut_docs(docs: DataFrame, id_col: str, text_col: str, as_text: bool = False) -> DataFrame:
    """Every row as ``row`` with ``n_bytes``, ``n_removed``, ``n_spans`` and what is ``kept``, as bytes or as text."""
    kept_type = "string" if as_text else "binary"
    base = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    long = F.octet_length("body") >= LENGTH
    total = base.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    sha = F.unhex(F.sha2("body", 256))
    shared = held(
        base.where(long).select(sha.alias("sha"), "id").groupBy("sha").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("sha", "lead")
    )
    marked = base.withColumn("sha", sha).join(small_side(shared), "sha", "left").drop("sha")
    later = F.col("lead").isNotNull() & (F.col("id") > F.col("lead"))
    copies = marked.where(later)
    own = marked.where(~later)

    bits = lambda rows: max(0, math.ceil(math.log2(max(1, rows / SHARD_STRETCHES))) + 2)
    found = stored(repeats(own.where(long).select("id", "body"), all_stretches, bits(total * 0.075), True))
    ends = found.where("kind = 1").groupBy(F.col("doc").alias("id")).agg(F.collect_list("names").alias("ends"))
    number = found.where("kind = 1").agg(F.sum(F.octet_length("names"))).first()[0] or 0
    ids = held(found.where("kind = 1").select(F.col("doc").alias("id")).distinct())
    ended = own.where(long).select("id", "body").join(small_side(ids), "id", "left_semi").join(ends, "id")
    strings = stored(repeats(ended, strings_of_ends, bits(number / 8 * PLACES / 2), False))
    names = found.where("kind = 0").select("doc", "names", F.lit(0).alias("kind")).unionByName(strings.select("doc", "names", F.lit(1).alias("kind")))
    marks = names.groupBy(F.col("doc").alias("id")).agg(
        F.collect_list(F.when(F.col("kind") == 0, F.col("names"))).alias("whole"),
        F.collect_list(F.when(F.col("kind") == 1, F.col("names"))).alias("single"),
    )
    touched = small_side(held(names.select(F.col("doc").alias("id")).distinct()))

    @F.pandas_udf(CUT + kept_type)
    def cut(bodies: pd.Series, whole: pd.Series, single: pd.Series) -> pd.DataFrame:
        raw = [t.encode() for t in bodies]
        rows = []
        for a, b in slices(map(len, raw), SLICE_BYTES, 20_000):
            rows += cut_out(raw[a:b], [_joined(x) for x in whole[a:b]], [_joined(x) for x in single[a:b]])
        if as_text:
            rows = [(*r[:3], r[3].decode("utf-8", "ignore")) for r in rows]
        give_back()
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    size = F.octet_length("body").cast("bigint")
    zero = F.lit(0).cast("bigint")
    out = own.join(touched, "id", "left_semi").join(marks, "id").withColumn("r", cut("body", "whole", "single")).select("row", "r.*")
    plain = own.join(touched, "id", "left_anti").select("row", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("body").cast(kept_type).alias("kept"))
    gone = copies.select("row", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit("").cast(kept_type).alias("kept"))
    return out.unionByName(plain).unionByName(gone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay.

    A byte goes if a 50-byte string over it also starts in a document with a
    smaller id, judged on the texts as they are.  Null text is empty.  Rows with
    equal ids are one document in this, so they never take from each other; a
    null id is larger than any other.  Texts under 50 bytes stay.  Copies of a
    whole text are found by SHA-256 first and take no part after that.  An empty
    table gives no rows.
    """
    return _cut_docs(docs, id_col, text_col).select(F.col(f"row.`{id_col}`").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the text that stays; a character that lost some of its bytes goes as a whole.

    A text from which nothing is cut stays as it is, null included.
    """

    null = free_name(docs, "_was_null")
    cut = _cut_docs(docs.withColumn(null, F.col(f"`{text_col}`").isNull()), id_col, text_col, True)
    text = F.when(~F.col(f"row.`{null}`"), F.col("kept"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
