import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import features as E
from wayfind.operators import similarity as S

BAGS = ("function_name", "description", "parameters")
TYPE = "key int, action string, target string, function_name array<string>, description array<string>, parameters array<string>"


def table(seed, n):
    rng = random.Random(seed)
    bag = lambda: rng.sample("abcdefghij", rng.randrange(0, 4)) or ["none"]
    return [(i, rng.choice(["get", "set", "none"]), rng.choice(["x", "none"]), bag(), bag(), bag()) for i in range(n)]


def brute(q, c, encoding):
    names = ("action", "target", *BAGS)
    sims = {}
    for i, n in enumerate(names, 1):
        if n in BAGS:
            a, b = set(q[i]), set(c[i])
            sims[n] = len(a & b) / math.sqrt(len(a) * len(b))
        else:
            sims[n] = float(q[i] == c[i])
    total = weight = 0.0
    for layer in encoding.layers:
        roles = [r for r in encoding.roles if r.layer == layer]
        mean = sum(sims[r.name] * r.weight for r in roles) / sum(r.weight for r in roles)
        total += mean * roles[0].layer_weight
        weight += roles[0].layer_weight
    return round(total / weight, 9)


@pytest.mark.parametrize("k, copies", [(1, False), (3, False), (5, True)])
def test_top_k_is_exact_over_all_pairs(spark, k, copies):
    q, c = table(1, 12), table(2, 60)
    got = rows(S.top_k(spark.createDataFrame(q, TYPE), spark.createDataFrame(c, TYPE), E.GENERIC, "key", "key", k, copies))
    want = []
    for a in q:
        best = sorted(((-brute(a, b, E.GENERIC), b[0]) for b in c))[:k]
        want += [(a[0], key, round(-s, 9), r) for r, (s, key) in enumerate(best, 1)]
    assert [(a, b, pytest.approx(s), r) for a, b, s, r in got] == sorted(want)


def test_empty_bags_match_each_other(spark):
    q = spark.createDataFrame([(1, ["none"])], "key int, words array<string>")
    c = spark.createDataFrame([(7, ["none"]), (8, ["a"])], "key int, words array<string>")
    assert rows(S.top_k(q, c, E.MEMORY, "key", "key", 2)) == [(1, 7, 1.0, 1), (1, 8, 0.0, 2)]


def test_pairs_beyond_the_broadcast_bound(spark, monkeypatch):
    from wayfind.operators import scale

    q, c = spark.createDataFrame(table(1, 12), TYPE), spark.createDataFrame(table(2, 60), TYPE)
    plain = rows(S.score_overlapping(q, c, E.GENERIC, "key", "key"))
    monkeypatch.setattr(scale, "is_small", lambda *a, **k: False)
    assert rows(S.score_overlapping(q, c, E.GENERIC, "key", "key")) == plain


def test_plan_has_no_cross_join_and_limits_before_the_shuffle(spark):
    q, c = spark.createDataFrame(table(1, 12), TYPE), spark.createDataFrame(table(2, 60), TYPE)
    plan = S.top_k(q, c, E.GENERIC, "key", "key", 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") >= 2


def test_same_result_for_any_number_of_partitions(spark):
    q, c = spark.createDataFrame(table(1, 12), TYPE), spark.createDataFrame(table(2, 60), TYPE)
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(S.top_k(q, c, E.GENERIC, "key", "key", 3)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_missing_role_renormalises(spark):
    sims = {"action": F.lit(1.0), "target": F.lit(None).cast("double"), "function_name": F.lit(0.5), "description": F.lit(None).cast("double"), "parameters": F.lit(None).cast("double")}
    got = spark.range(1).select(S.layered(sims, E.GENERIC)).first()[0]
    assert got == pytest.approx((1.0 * 1.0 + 0.5 * 0.9) / 1.9)


def test_best_score_has_a_floor_and_relevance_is_inclusive(spark):
    q = spark.createDataFrame([(1, ["a"])], "key int, words array<string>")
    c = spark.createDataFrame([(7, ["b"])], "key int, words array<string>")
    assert rows(S.best_score(q, c, E.MEMORY, "key", "key")) == [(1, 0.0)]
    flags = S.relevant(spark.createDataFrame([(1, 0.2), (2, 0.19)], "query int, score double"))
    assert rows(flags.select("query", "is_relevant")) == [(1, True), (2, False)]
