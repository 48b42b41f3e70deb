"""What the operators of this subpackage share: tables cut from lineage, folds, words of a batch."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a session that runs in one process (``local[n]``, as in tests) may
    leave the setting out; a cluster without it is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wayfind-shared-")
    return f"{root.rstrip('/')}/wayfind-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a written table: cuts the lineage, and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """A narrow table that is used more than once, kept by the executors; what one of them loses is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


SMALL_ROWS = 250_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a broadcast if a count shows at most ``rows`` narrow rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sample_by_hash(df: DataFrame, bound: int, *key: str) -> DataFrame:
    """At most ``bound`` rows, the first by a hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(*key), *key).limit(bound)


def slices(sizes: Iterable[int], most: int, rows: int) -> Iterable[tuple[int, int]]:
    """Cut a batch into runs of at most ``rows`` rows and about ``most`` in size; one row is never cut."""
    start, held = 0, 0
    at = -1
    for at, size in enumerate(sizes):
        if at > start and (held + size > most or at - start >= rows):
            yield start, at
            start, held = at, 0
        held += size
    if at >= start:
        yield start, at + 1


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space words of some texts: row of each word, its code, and the distinct words by code."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    counts = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), counts)
    code = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    if "" in distinct:  # at the ends of a text
        full = code != distinct.index("")
        row, code = row[full], code[full]
    return row, code.astype(np.int64), distinct


def give_back() -> None:
    """Return what a task no longer needs to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the published splitmix64 finaliser), element by element."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
