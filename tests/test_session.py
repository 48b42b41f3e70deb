import random

from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import retrieval as P
from wayfind.operators import session as T


def walk(folders):
    path, out = [], []
    for f in folders:
        if f == "..":
            path = path[:-1]
        elif f and f != ".":
            path = [*path, f]
        out.append("/".join(path))
    return out


def test_working_path_of_short_and_very_long_conversations(spark):
    rng = random.Random(1)
    conversations = {1: [rng.choice(["..", "..", "a", "b", ".", "", None]) for _ in range(5000)], 2: ["..", "x", "..", "..", "y"], 3: ["a"] * 70}
    data = [(c, i, f) for c, fs in conversations.items() for i, f in enumerate(fs, 1)]
    df = spark.createDataFrame(data, "c int, turn long, folder string")
    got = rows(T.working_path(df, "c", "turn", F.col("folder")).select("c", "turn", F.array_join("path", "/")))
    want = [(c, i, p) for c, fs in conversations.items() for i, p in enumerate(walk(fs), 1)]
    assert got == sorted(want)


def test_path_steps(spark):
    cases = [(["a", "b"], ["a", "c"], ["..", "c"]), ([], ["a"], ["a"]), (["a"], ["a"], []), (["a", "b"], [], ["..", ".."]), (["a"], ["b", "a"], ["..", "b", "a"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = [r.s for r in df.select("i", T.path_steps(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_history_in_blocks_is_whole(spark):
    df = spark.createDataFrame([(1, i, f"q{i}") for i in range(1, 11)], "c int, pos int, q string")
    recent = {r.pos: r.recent for r in T.history(df, "c", "pos", F.col("q"), block=4).collect()}
    assert recent == {pos: [f"q{i}" for i in range(1, pos)] for pos in range(1, 11)}


def test_called_before_and_prerequisites(spark):
    calls = spark.createDataFrame([(1, 1, "start"), (1, 2, "lock"), (1, 3, "start"), (1, 4, "post")], "c int, turn int, func string")
    seen = T.called_before(calls, "c", "func", "turn")
    assert rows(seen.select("turn", F.array_join("called", ","))) == [(1, ""), (2, "start"), (3, "lock,start"), (4, "lock,start")]
    rules = spark.createDataFrame([("start", "lock", True), ("post", "login", True), ("post", "start", False)], "func string, prereq string, one_shot boolean")
    available = spark.createDataFrame([(1, "lock"), (1, "start")], "c int, func string")
    out = T.inject_prerequisites(calls, rules, "c", "turn", "func", T.first_calls(calls, "c", "func", "turn"), available)
    assert rows(out) == [(1, 1, "lock"), (1, 4, "start")]


def test_holdout_at_the_first_turn_has_nothing_to_replay(spark):
    turns = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "c int, turn int, q string")
    added = spark.createDataFrame([(1, 1, "f"), (1, 3, "g")], "c int, turn int, names string")
    out = {r.turn: (r.text, r.is_holdout) for r in T.holdout(turns, added, "c", "turn", "q", F.col("turn")).collect()}
    assert out[1] == ("Added functions: f; no open request", False)
    assert out[2] == ("b", True)
    assert out[3][0] == "Added functions: g; open request: b"


def test_mentions_quoted_bare_and_new(spark):
    df = spark.createDataFrame([("copy 'a.txt' and notes into 'new' and \"x.md\"",)], "t string")
    files, dirs = T.mentions(F.col("t"), F.array(F.lit("notes"), F.lit("a.txt")), F.array(F.lit("docs")))
    row = df.select(files.alias("f"), dirs.alias("d")).first()
    assert row.f == ["a.txt", "notes", "x.md"] and row.d == ["new"]


def test_tree_with_a_cycle_is_refused(spark):
    import pytest

    nodes = spark.createDataFrame([("a", None, "A", "directory"), ("b", "a", "B", "directory"), ("c", "b", "C", "file")], "node string, parent string, name string, kind string")
    assert rows(T.flatten_tree(nodes).select(F.array_join("path", "/"))) == [("A",), ("A/B",), ("A/B/C",)]
    ring = nodes.union(spark.createDataFrame([("b", "c", "B", "directory")], nodes.schema))
    with pytest.raises(ValueError):
        T.flatten_tree(ring)


def test_windows_cross_messages_and_shrink_at_the_end(spark):
    df = spark.createDataFrame([(1, 1, "First clause. Second clause."), (1, 2, "tiny"), (1, 3, "Third clause here")], "c int, turn int, t string")
    out = rows(P.conversation_windows(df, "c", ["turn"], F.col("turn"), "t", 2).select("pos", "passage"))
    assert out == [(0, "First clause. Second clause."), (1, "Second clause. Third clause here"), (2, "Third clause here")]


def test_prefix_chain_of_a_long_conversation(spark):
    data = [(c, p, f"{c}.{p}" if p % 5 else None) for c, n in ((1, 40), (2, 3), (3, 17)) for p in range(1, n + 1)]
    df = spark.createDataFrame(data, "c int, pos int, q string").repartition(3)
    got = {(r.c, r.pos): r.recent for r in T.history(df, "c", "pos", F.col("q"), block=3).collect()}
    assert got == {(c, p): [f"{c}.{i}" for i in range(1, p) if i % 5] for c, p, _ in data}
    plan = T.history(df, "c", "pos", F.col("q"), block=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [c#" in plan or "BroadcastHashJoin [c#" in plan
