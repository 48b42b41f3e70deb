"""Per-conversation state on a stream of calls."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfind.sources.catalog import latest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 512
ROWS_IN = 100_000
ROWS_OUT = 2_000
SHARDS = 1_024
NO_TIME = -(1 << 63)

OUTPUT = T.StructType([
    T.StructField("conversation", T.LongType()),
    T.StructField("block", T.StringType()),
    T.StructField("call", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("pops", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("called", T.ArrayType(T.StringType())),
])


class Change:
    """Levels left, levels entered, functions called and number of calls: of a run of calls, or of all before a block."""

    def __init__(self, n: int = 0, pops: int = 0, path: list[str] | None = None, called: set[str] | None = None):
        self.n, self.pops, self.path, self.called = n, pops, path or [], called or set()

    def call(self, func: str | None, folder: str | None) -> None:
        self.n += 1
        if folder == "..":
            if self.path:
                self.path = self.path[:-1]
            else:
                self.pops += 1
        elif folder and folder != ".":
            self.path = [*self.path, folder]
        if func is not None:
            self.called = self.called | {func}

    def then(self, later: Change) -> Change:
        """Both in a row."""
        left = max(0, later.pops - len(self.path))
        path = self.path[:len(self.path) - later.pops] if left == 0 else []
        return Change(self.n + later.n, self.pops + left, path + later.path, self.called | later.called)

    def told(self) -> tuple:
        return (self.n, self.pops, json.dumps(self.path), json.dumps(sorted(self.called)))

    @classmethod
    def of(cls, value: tuple) -> Change:
        return cls(value[0], value[1], json.loads(value[2]), set(json.loads(value[3])))


class Sessions(StatefulProcessor):
    """Working path, functions called before, and number of calls, in the order of the calls' times.

    A conversation's calls lie in blocks of about ``BLOCK`` in the order of their
    times, each with a summary that composes.  A call is told relative to its
    block; of a block, what all calls before it come to.  A late call opens only
    its own block, and renews the totals of the later ones from their summaries.

    Many conversations share a group, whose rows are read and told in frames of
    thousands: a frame or two per conversation costs more than its calls.  One
    that is a single block is one state entry, read once and written once.
    """

    def __init__(self, ttl_ms: int | None = None, block: int = BLOCK):
        self.ttl_ms = ttl_ms
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Where each block begins, in order: three numbers or names per block, whatever its calls; the calls of an only block.
        self.heads = handle.getMapState("heads", "conversation string", "version bigint, blocks string, only string", self.ttl_ms)
        self.calls = handle.getMapState("calls", "conversation string, block string", "calls string", self.ttl_ms)
        self.sums = handle.getMapState("sums", "conversation string, block string", "n bigint, pops int, path string, called string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for arrived in self._gathered(rows):
            for conversation, new in arrived.items():
                for row in self._taken(conversation, sorted(new, key=lambda c: (c[0], c[1]))):
                    out.append(row)
                    if len(out) >= ROWS_OUT:
                        yield self._frame(out)
                        out = []
        yield self._frame(out)

    @staticmethod
    def _gathered(rows: Iterator[pd.DataFrame]) -> Iterator[dict[str | None, list]]:
        """The calls of each conversation, of at most ``ROWS_IN`` rows and a frame at a time."""
        arrived, n = {}, 0
        for part in rows:
            for conversation, *c in zip(*(part[x].tolist() for x in ("conversation", "at", "event_id", "func", "folder"))):
                arrived.setdefault(conversation, []).append(c)
            n += len(part)
            if n >= ROWS_IN:
                yield arrived
                arrived, n = {}, 0
        yield arrived

    def _taken(self, conversation: str | None, new: list) -> Iterator[tuple]:
        """Take in calls of one conversation; the rows to be told anew."""
        version, told, only = self.heads.getValue((conversation,)) or (0, "[]", None)
        blocks, own = json.loads(told), None if conversation is None else int(conversation)
        places: dict[int, list] = {}
        for c in new:
            places.setdefault(max(0, bisect_right(blocks, [int(c[0]), int(c[1]), "\U0010ffff"]) - 1), []).append(c)
        first = None
        for place in sorted(places, reverse=True):  # from the end, so that places before stay as they are
            version += 1
            pieces = self._placed(conversation, blocks[place][2] if blocks else None, only, places[place], version)
            alone = len(pieces) == 1 and len(blocks) <= 1
            only = json.dumps(pieces[0][1]) if alone else None
            for name, calls in () if alone else pieces:
                self._store(conversation, name, calls)
            # The first block also holds what comes before its first call.
            blocks[place:place + 1] = [[int(calls[0][0]), int(calls[0][1]), name] for name, calls in pieces]
            low = blocks[place][:2]
            first = low if first is None else min(first, low)
            for name, calls in pieces:
                yield from self._told(own, name, calls, version)
        version += 1
        before = Change()
        for k, (at, event, name) in enumerate(blocks):
            if [at, event] >= first:
                yield (own, name, None, version, before.n, 0, before.path, sorted(before.called))
            if k + 1 < len(blocks):
                before = before.then(Change.of(self.sums.getValue((conversation, name))))
        self.heads.updateValue((conversation,), (version, json.dumps(blocks), only))

    def _store(self, conversation: str | None, name: str, calls: list) -> None:
        change = Change()
        for _, _, func, folder in calls:
            change.call(func, folder)
        self.calls.updateValue((conversation, name), (json.dumps(calls),))
        self.sums.updateValue((conversation, name), change.told())

    def _placed(self, conversation: str | None, name: str | None, only: str | None, new: list, version: int) -> list[tuple[str, list]]:
        """The block with the new calls in it, in pieces if it has become long; a call that comes again takes its own place."""
        held = json.loads(only or self.calls.getValue((conversation, name))[0]) if name else []
        merged = {(int(c[0]), int(c[1])): (c[2], c[3]) for c in held}
        for at, event, func, folder in new:
            merged[int(at), int(event)] = (func if isinstance(func, str) else None, folder if isinstance(folder, str) else None)
        calls = [(*at, *merged[at]) for at in sorted(merged)]
        size = self.block if len(calls) > 2 * self.block else len(calls)
        # A name is never used twice: by the call that opens the block, and the version.
        return [
            (name if a == 0 and name else f"{calls[a][1]}.{version}.{a}", calls[a:a + size])
            for a in range(0, len(calls), size)
        ]

    @staticmethod
    def _told(conversation: int | None, name: str, calls: list, version: int) -> Iterator[tuple]:
        change = Change()
        for _, event, func, folder in calls:
            called = sorted(change.called)
            change.call(func, folder)
            yield (conversation, name, event, version, change.n, change.pops, change.path, called)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[f.name for f in OUTPUT.fields])
        return frame.astype({"conversation": "Int64", "call": "Int64", "version": "int64", "turn": "int64", "pops": "int32"})

    def close(self) -> None:
        pass


def session_stream(calls: DataFrame, ttl_ms: int | None = None, block: int = BLOCK) -> DataFrame:
    """Changes after every call of ``calls(conversation, event_id, ts, func, folder)``, and totals of blocks.

    A call's row is relative to its block, and the row of a block (without
    ``call``) says what comes before it; :func:`current` puts the latest of both
    together.  A call without a time comes before all others, one that is
    delivered again replaces itself.  Needs the RocksDB state store (see
    :data:`ROCKSDB`).  ``ttl_ms`` drops the state of conversations that have gone quiet.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME))
    shard = F.pmod(F.xxhash64("conversation"), F.lit(SHARDS)).cast("int").alias("shard")
    # As text, a missing conversation doesn't turn the others into floating point numbers.
    calls = calls.select(shard, F.col("conversation").cast("string").alias("conversation"), "event_id", at.alias("at"), "func", "folder")
    return calls.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Sessions(ttl_ms, block), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def current(states: DataFrame) -> DataFrame:
    """The state after every call, from the rows of all batches: ``(conversation, call, turn, path, called)``.

    Calls meet the totals of their own block, so a long conversation is spread
    over tasks.
    """
    order = ["batch", "version"]
    calls = latest(states.where(F.col("call").isNotNull()), ["conversation", "call"], order)
    totals = latest(states.where(F.col("call").isNull()).drop("call", "pops"), ["conversation", "block"], order)
    before = totals.select("conversation", "block", F.col("turn").alias("_n"), F.col("path").alias("_path"), F.col("called").alias("_called"))
    joined = calls.join(before, ["conversation", "block"])
    kept = F.slice("_path", F.lit(1), F.greatest(F.size("_path") - F.col("pops"), F.lit(0)))
    return joined.select(
        "conversation", "call", (F.col("_n") + F.col("turn")).alias("turn"), F.array_join(F.concat(kept, "path"), "/").alias("path"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_called", "called"))), "|").alias("called"),
    )
