"""Scores made inside rows: layered top-k, entries of a small catalog, four levels, centroid blocks, containment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_similarity import TYPE, brute, table
from wayfind.functions import vectors as V
from wayfind.operators import contain, levels, nearest, rowscore
from wayfind.operators import features as E
from wayfind.operators import select as L
from wayfind.operators import similarity as S


def best_pairs(q, c, k):
    want = []
    for a in q:
        best = sorted(((-brute(a, b, E.GENERIC), b[0]) for b in c))[:k]
        want += [(a[0], key, round(-s, 9), r) for r, (s, key) in enumerate(best, 1)]
    return sorted(want)


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("slice_rows", [7, 1_024])
def test_rows_and_index_agree_with_all_pairs(spark, monkeypatch, k, slice_rows):
    monkeypatch.setattr(rowscore, "SLICE_ROWS", slice_rows)
    q, c = table(5, 30), table(6, 400)
    left, right = spark.createDataFrame(q, TYPE), spark.createDataFrame(c, TYPE).repartition(3)
    inside = S.top_k(left, right, E.GENERIC, "key", "key", k)
    indexed = S.top_k(left, right, E.GENERIC, "key", "key", k, max_queries=0)
    want = best_pairs(q, c, k)
    for got in (rows(inside), rows(indexed)):
        assert [(a, b, pytest.approx(s), r) for a, b, s, r in got] == want
    assert "Exchange hashpartitioning(q_key" not in inside._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [256, 5])
def test_pairs_above_a_score(spark, monkeypatch, part):
    monkeypatch.setattr(rowscore, "PART", part)
    q, c = table(11, 20), table(12, 300)
    left, right = spark.createDataFrame(q, TYPE), spark.createDataFrame(c, TYPE).repartition(3)
    want = sorted((a[0], b[0], brute(a, b, E.GENERIC)) for a in q for b in c if brute(a, b, E.GENERIC) >= 0.6)
    inside = S.pairs_above(left, right, E.GENERIC, "key", "key", 0.6)
    assert [(a, b, pytest.approx(s)) for a, b, s in rows(inside)] == want and want
    assert "Exchange hash" not in inside._jdf.queryExecution().executedPlan().toString()
    assert [(a, b, pytest.approx(s)) for a, b, s in rows(S.pairs_above(left, right, E.GENERIC, "key", "key", 0.6, max_queries=8))] == want


def encoded(data):
    """Rows as an Arrow batch, as a task gets them."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 3]
    names = ["key", "action", "target", "function_name", "description", "parameters"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*data), kinds)], names=names)


def test_bounds_cut_rows_but_never_a_best_one(spark):
    rng = random.Random(3)
    common = [f"c{k}" for k in range(30)]
    bag = lambda n: rng.sample(common, n) + ([f"r{rng.randrange(200)}"] if rng.random() < 0.2 else [])
    make = lambda n, size: [(i, "a", rng.choice("xy"), bag(size), bag(size), ["none"]) for i in range(n)]
    q, c = make(6, 3), make(3_000, 12)
    q[0] = (0, "a", "x", c[17][3], c[17][4], ["none"])
    side = rowscore.query_side(spark.createDataFrame(q, TYPE), "key", E.GENERIC)
    scorer, best, kept = rowscore.Scorer(side, E.GENERIC), rowscore.Best(6, 2, 2), 0
    for a in range(0, len(c), 300):
        batch = encoded(c[a:a + 300])
        keep, raw = scorer.scores(batch, best.bound)
        kept += len(keep)
        best.offer(raw, [key[keep] for key in rowscore.ordered_keys(batch, ["key"])])
        best.prune()
    assert kept < len(c)
    found = {(int(a), int(b)) for a, b in zip(best.query, best.keys[1])}
    assert {(a, b) for a, b, _, _ in best_pairs(q, c, 2)} <= found


def test_a_flood_of_ties_is_held_to_k(spark):
    c = spark.range(50_000).select(F.col("id").alias("key"), F.array(F.lit("a")).alias("words")).repartition(2)
    q = spark.createDataFrame([(1, ["zz"]), (2, ["a"])], "key int, words array<string>")
    assert rows(S.top_k(q, c, E.MEMORY, "key", "key", 3)) == [(1, 0, 0.0, 1), (1, 1, 0.0, 2), (1, 2, 0.0, 3), (2, 0, 1.0, 1), (2, 1, 1.0, 2), (2, 2, 1.0, 3)]
    for step in (1, -1):
        best, keys = rowscore.Best(1, 3, 2), np.arange(1, 9_001)[::step]
        for a in range(0, 9_000, 1_000):
            best.offer(np.zeros((1_000, 1)), [np.ones(1_000, bool), keys[a:a + 1_000]])
            assert best.held == 0 or step < 0
        best.prune()
        assert best.keys[1].tolist() == [1, 2, 3]


def test_null_bags_and_categories_are_absent(spark):
    q = spark.createDataFrame([(1, None, "x", ["a"], ["b"], None)], TYPE)
    c = spark.createDataFrame([(7, "get", "x", ["a"], ["z"], ["p"]), (8, "get", None, ["a"], None, ["p"]), (None, None, None, None, None, None)], TYPE)
    got = {r.candidate: r.score for r in S.top_k(q, c, E.GENERIC, "key", "key", 3).collect()}
    assert got == {8: 1.0, 7: pytest.approx(0.55), None: 0.0}


def test_several_keys_stand_for_a_candidate(spark):
    c = spark.createDataFrame([(1, 2, ["a"]), (1, 1, ["a"]), (0, 9, ["b"])], "doc int, pos int, words array<string>")
    q = spark.createDataFrame([(5, ["a"])], "key int, words array<string>")
    want = [(5, 1, 1, 1.0, 1), (5, 1, 2, 1.0, 2)]
    assert rows(S.top_k(q, c, E.MEMORY, "key", ["doc", "pos"], 2)) == want
    assert rows(S.top_k(q, c, E.MEMORY, "key", ["doc", "pos"], 2, max_queries=0)) == want


def test_entries_of_a_small_catalog_per_row(spark):
    q, c = table(8, 200), table(9, 40)
    side = rowscore.query_side(spark.createDataFrame(c, TYPE), "key", E.GENERIC)
    got = rowscore.best_entries(side, spark.createDataFrame(q, TYPE).repartition(3), E.GENERIC, "key", 3, spark.createDataFrame(c, TYPE).schema["key"].dataType)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(a, b, pytest.approx(s), r) for a, b, s, r in rows(got)] == best_pairs(q, c, 3)
    none = rowscore.query_side(spark.createDataFrame([], TYPE), "key", E.GENERIC)
    assert rowscore.best_entries(none, spark.createDataFrame(q, TYPE), E.GENERIC, "key", 3, spark.createDataFrame(c, TYPE).schema["key"].dataType).count() == 0


# four levels

SHAPE = levels.Shape({"name": ("n",), "meaning": ("d", "p")}, {"name": ("name",), "meaning": ("meaning",)})


def plain_levels(spark, q, c):
    """All pairs by the vectors themselves."""
    def vectors(data):
        df = spark.createDataFrame(data, "key int, n array<string>, d array<string>, p array<string>")
        got = df.select("key", *[V.bundle(42, F.col(r), 128).alias(r) for r in "ndp"]).collect()
        out = {}
        for r in got:
            v = {x: np.array(r[x], float) for x in "ndp"}
            v["s"] = np.sign(v["d"] + v["p"])
            v["x"] = np.sign(v["n"] + v["s"])
            out[r.key] = v
        return out

    def cos(a, b):
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / scale if scale else 0.0

    out = {}
    for a, u in vectors(q).items():
        for b, v in vectors(c).items():
            mean = (cos(u["n"], v["n"]) + cos(u["s"], v["s"])) / 2
            out[a, b] = 0.05 * cos(u["x"], v["x"]) + 0.35 * mean + 0.6 * sum(cos(u[r], v[r]) for r in "ndp") / 3
    return out


def test_ranking_by_four_levels(spark, monkeypatch):
    monkeypatch.setattr(levels, "SLICE_ROWS", 32)
    rng = random.Random(4)
    bag = lambda: rng.sample([f"w{k}" for k in range(25)], rng.randrange(0, 5))
    q, c = [(i, bag(), bag(), bag()) for i in range(6)], [(i, bag(), bag(), bag()) for i in range(150)]
    kind = "key int, n array<string>, d array<string>, p array<string>"
    side = lambda data: levels.bundled(spark.createDataFrame(data, kind), SHAPE, 42, 128)
    got = rows(levels.rank_levels(side(q), side(c).repartition(2), SHAPE, "key", ["key"], 4, 128))
    scores = plain_levels(spark, q, c)
    for a in range(6):
        best = sorted((-round(s, 6), b) for (x, b), s in scores.items() if x == a)[:4]
        mine = sorted((r for r in got if r[0] == a), key=lambda r: r[3])
        assert [r[2] for r in mine] == pytest.approx([-s for s, _ in best], abs=2e-6)
        assert all(scores[a, r[1]] == pytest.approx(r[2], abs=2e-6) for r in mine)
    with pytest.raises(ValueError):
        levels.rank_levels(side(q), side(c), SHAPE, "key", ["key"], 4, 128, max_queries=3)


# centroid blocks

@pytest.mark.parametrize("block", [256, 3])
def test_centroid_blocks(spark, block):
    rng = random.Random(5)
    data = [(i, i % 10, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(data, "id int, label int, v array<double>")
    means = nearest.centroids(df, "label", "v")
    blocks = nearest.CentroidBlocks(means, "label", block=block)
    assert blocks.labels == 10
    center = {k: np.mean([v for _, m, v in data if m == k], axis=0) for k in range(10)}
    want = {(i, k): np.dot(v, m) / np.linalg.norm(v) / np.linalg.norm(m) for i, _, v in data for k, m in center.items()}
    every = blocks.scores(df, "id", "v")
    assert {(r.query, r.candidate): r.score for r in every.collect()} == pytest.approx(want, abs=1e-8)
    assert rows(L.top_k(blocks.scores(df, "id", "v", 3), 3)) == rows(L.top_k(every, 3))
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


# containment

def test_containment_of_every_text_in_every_other(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: "  ".join(rng.choice(words) for _ in range(n)) + "."
    texts = [(i, text(rng.randrange(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "w1 w2 w3")]
    wanted = [(i, t[rng.randrange(0, 5):][:rng.randrange(1, 40)]) for i, (_, t) in enumerate(texts[:120])]
    wanted += [(300, "w1"), (301, "!!"), (302, None), (303, "w2 w3"), (304, "nowhere at all to be found"), (305, "w1"), (306, "1  w2  W")]
    plain = lambda s: "".join(c for c in (s or "").lower() if c.isalnum() and c.isascii() or c in "_ \n").strip()
    want = sorted((i, j) for i, t in texts for j, w in wanted if plain(w) and plain(w) in plain(t))
    left, right = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(wanted, "item int, text string")
    for inline in (20_000, 0):
        assert rows(contain.contained_in(left, "id", "text", right, "item", "text", inline, inline)) == want
