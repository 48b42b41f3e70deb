"""Streams: sessions in blocks, results once each, catalogs by version."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import features as E
from wayfind.streaming import io, metrics, routes, sessions

CALLS = "conversation long, event_id long, ts long, func string, folder string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)


def told(calls):
    """State after every call, by walking through all of them."""
    out = []
    for conversation in sorted({c[0] for c in calls}):
        path, called = [], set()
        own = sorted((c for c in calls if c[0] == conversation), key=lambda c: (c[2] if c[2] is not None else -1, c[1]))
        for turn, (_, event, _, func, folder) in enumerate(own, 1):
            path = path[:-1] if folder == ".." else [*path, folder] if folder and folder != "." else path
            out.append((conversation, event, turn, "/".join(path), "|".join(sorted(called))))
            called |= {func} - {None}
    return sorted(out)


def streamed(spark, tmp_path, files, block):
    for k, part in enumerate(files):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = io.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], CALLS).schema, files_per_trigger=1)
    calls = stream.withColumn("ts", F.timestamp_seconds("ts"))
    io.drain(sessions.session_stream(calls, block=block), str(tmp_path), lambda b, n: io.replace_batch(b, n, str(tmp_path / "out")))
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_late_calls_in_any_order(spark, tmp_path, block):
    rng = random.Random(block)
    calls = [(c, c * 1000 + i, rng.randrange(60) if i else None, rng.choice(["f", "g", "h", None]), rng.choice(["a", "b", "..", "..", ".", "", None])) for c in (1, 2) for i in range(70)]
    rng.shuffle(calls)
    files = [calls[a:a + 35] for a in range(0, len(calls), 35)] + [calls[:9]]  # some come twice
    found = streamed(spark, tmp_path, files, block)
    assert rows(sessions.current(found).select("conversation", "call", "turn", "path", "called")) == told(calls)


def test_a_conversation_of_100_000_calls(spark, tmp_path):
    n = 100_000
    folder = F.when(F.col("id") % 3 == 2, "..").otherwise(F.concat(F.lit("d"), F.col("id") % 7))
    calls = spark.range(n).select(F.lit(1).cast("long").alias("conversation"), F.col("id").alias("event_id"), F.col("id").alias("ts"), F.concat(F.lit("f"), F.col("id") % 5).alias("func"), F.when(F.col("id") % 1000 < 3, folder).otherwise("").alias("folder"))
    calls.where(F.col("event_id") != 50_000).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls.where(F.col("event_id") == 50_000).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = io.file_stream(spark, str(tmp_path / "in"), calls.schema, files_per_trigger=1).withColumn("ts", F.timestamp_seconds("ts"))
    io.drain(sessions.session_stream(stream), str(tmp_path), lambda b, k: io.replace_batch(b, k, str(tmp_path / "out")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("batch = 1 and call is not null").count() <= 2 * sessions.BLOCK  # the late call's own block
    path, paths = [], {}
    for i in range(n):
        if i % 1000 < 3:
            path = path[:-1] if i % 3 == 2 else [*path, f"d{i % 7}"]
        paths[i] = "/".join(path)
    last = rows(sessions.current(out).where("call in (49999, 50000, 50001, 99999)").select("call", "turn", "path", "called"))
    assert last == [(i, i + 1, paths[i], "f0|f1|f2|f3|f4") for i in (49_999, 50_000, 50_001, 99_999)]


def test_a_result_that_comes_again_with_other_content(spark, tmp_path):
    first = [(1, "k", True, 2.0), (2, "k", False, 1.0), (2, "k", True, 9.0), (3, "j", None, 4.0), (None, "j", True, 1.0), (None, "k", True, 1.0)]
    again = [(1, "k", False, 7.0), (4, "k", True, 3.0), (3, "k", True, 0.5)]
    kind = "id long, cat string, ok boolean, s double"
    for part in (first, again):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = io.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, files_per_trigger=1)
    path = metrics.metrics_stream(stream, "id", "cat", "ok", "s", str(tmp_path))
    counts = spark.read.parquet(path)
    assert rows(counts.groupBy("cat", "ok", "s").agg(F.sum("n")).na.fill({"ok": False})) == sorted([("k", True, 2.0, 1), ("k", False, 1.0, 1), ("j", False, 4.0, 1), ("j", True, 1.0, 1), ("k", True, 3.0, 1)])
    assert rows(metrics.report(counts, "cat", "ok", "s").where("cat = 'k'").select("total", "correct")) == [(3, 2)]


def test_the_catalog_is_encoded_once_per_version(spark, tmp_path):
    made = []

    def catalog():
        made.append(len(made))
        return spark.createDataFrame([(k, [f"w{(k + made[-1]) % 3}"]) for k in range(3)], "id int, words array<string>")

    stored = routes.StoredCatalog(catalog, E.MEMORY, "id", str(tmp_path), lambda: version[0])
    version, q = [1], spark.createDataFrame([(9, ["w0"])], "key int, words array<string>")
    for _ in range(3):
        assert rows(stored.route(q, "key", 1)) == [(9, 0, 1.0, 1)]
    version[0] = 2
    assert rows(stored.route(q, "key", 1)) == [(9, 2, 1.0, 1)]
    assert made == [0, 1]


def test_results_are_told_apart_without_python(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(metrics, "drain", lambda stream, *rest: kept.append(stream))
    spark.createDataFrame([(1, "k", True, 2.0)], "id long, cat string, ok boolean, s double").write.parquet(str(tmp_path / "in"))
    stream = io.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    metrics.metrics_stream(stream, "id", "cat", "ok", "s", str(tmp_path))
    plan = kept[0]._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


class Kept(dict):
    """A map state that counts what passes between a task and its store."""

    seen = 0

    def getValue(self, key):
        self.seen += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.seen += 1
        self[key] = value


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *kinds):
        return self.maps.setdefault(name, Kept())


def test_many_conversations_share_a_group_and_its_frames():
    handle, s = Handle(), sessions.Sessions()
    s.init(handle)
    rows = [(str(c), i, 100 * c + i, "f", "a") for i in range(3) for c in range(500)]
    part = lambda some: iter([pd.DataFrame(some, columns=["conversation", "at", "event_id", "func", "folder"])])
    first, second = list(s.handleInputRows((0,), part(rows[500:]), None)), list(s.handleInputRows((0,), part(rows[:500]), None))
    assert len(first) <= 2 and len(second) <= 2  # not a frame or two per conversation
    assert sum(m.seen for m in handle.maps.values()) == 2 * 2 * 500  # each read and written once per batch
    last = second[0][second[0]["conversation"] == 7]
    assert last[["call", "turn", "path"]].astype(object).values.tolist()[:3] == [[700, 1, ["a"]], [701, 2, ["a", "a"]], [702, 3, ["a", "a", "a"]]]
