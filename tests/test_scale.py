"""The hot-key and too-large-to-broadcast paths give the plain results."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.functions import text as X
from wayfind.operators import joins as J
from wayfind.operators import metrics as M
from wayfind.operators import mining as B
from wayfind.operators import rules as R
from wayfind.operators import scale


def hot(spark, n=600):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.5 else rng.randrange(2, 9), i // 2, i, rng.randrange(10)) for i in range(n)]
    return spark.createDataFrame(data, "k int, at long, id long, v int")


def test_ordered_window_with_hot_keys(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("at", "id")
    expected = df.select(
        "id", F.row_number().over(w).cast("bigint").alias("n"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("f"),
    )
    o = scale.Ordered(df, ["k"], ["at", "id"], F.col("at"), share=40)
    assert o.group == ["k", "_piece"]
    o.row_number("n").running("s", F.col("v")).previous("p", F.col("v")).following("f", F.col("v"))
    assert o.result().select("id", "n", "s", "p", "f").exceptAll(expected).isEmpty()
    assert o.result().count() == 600
    assert o.df.groupBy(*o.group).count().agg(F.max("count")).first()[0] < 100


def test_ordered_without_hot_keys_is_a_plain_window(spark):
    o = scale.Ordered(hot(spark), ["k"], ["at", "id"], F.col("at"))
    assert o.group == ["k"]


def test_join_lookup_beyond_the_bound(spark, monkeypatch):
    df = hot(spark).select("k", "id")
    lookup = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "k int, name string")
    real = scale.hot_keys
    monkeypatch.setattr(scale, "hot_keys", lambda d, keys: real(d, keys, share=100))
    for how in ("inner", "left"):
        small = scale.join_lookup(df, lookup, ["k"], how)
        large = scale.join_lookup(df, lookup, ["k"], how, max_rows=0)
        assert rows(large.select("k", "id", F.coalesce("name", F.lit("-")))) == rows(small.select("k", "id", F.coalesce("name", F.lit("-"))))


def test_rules_inline_and_joined_agree(spark):
    texts = spark.createDataFrame([(1, "Rename the old file, then move it"), (2, "a é thé bcd"), (3, "")], "id int, t string")
    rules = spark.createDataFrame(
        [("move", "mv", 1), ("rename", "rn", 2), ("old file", "of", 3), ("é t", "e", 4), ("a", "x", 5), ("name the", "nt", 6),
         ("old", "o2", 3), ("file", "f2", 1), ("file", "f2", 1), ("file", "f3", 1), ("", "all", 1)],
        "pattern string, canonical string, ordinal int",
    )
    for hits in (R.phrase_hits, R.word_hits):
        arg = F.col("t") if hits is R.phrase_hits else X.tokenize_spaced(F.col("t"))
        plain = hits(texts, "id", arg, rules)
        joined = hits(texts, "id", arg, rules, inline=0)
        pick = lambda d: rows(d.select("id", F.array_join(F.array_sort(F.transform("hits", lambda h: F.concat_ws(":", h["pattern"], h["canonical"], h["pos"]))), "|")))
        assert pick(plain) == pick(joined)


def test_nearest_rank_matches_definition(spark):
    rng = random.Random(5)
    data = [(g, float(rng.randrange(30))) for g in range(4) for _ in range(rng.randrange(1, 50))]
    df = spark.createDataFrame(data, "g int, v double")
    got = dict(rows(M.nearest_rank(df, ["g"], "v", 0.95)))
    for g in range(4):
        values = sorted(v for k, v in data if k == g)
        assert got[g] == values[max(0, -(-95 * len(values) // 100) - 1)]


def test_long_turns_have_the_same_form(spark):
    turns = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "turn int, query string")
    calls = [(t, i, "xy"[(i + (t == 3)) % 2]) for t in (1, 2, 3) for i in range(6)]
    df = spark.createDataFrame(calls, "turn int, at long, func string")
    out = dict(rows(B.turn_patterns(turns, df, ["turn"], "func", ["at"], F.col("at"), long_turn=3).select("turn", "pattern")))
    assert out == {1: "x|y|x|y|x|y", 2: "x|y|x|y|x|y", 3: "y|x|y|x|y|x", 4: "[]"}
    short = dict(rows(B.turn_patterns(turns, df, ["turn"], "func", ["at"], F.col("at")).select("turn", "pattern")))
    assert short == out


def test_few_entries_that_make_many_rows_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 50)
    entries = spark.range(0, 20, 1, 1).select(F.col("id").alias("e"), F.array(F.lit(1), F.lit(2)).alias("classes"))
    catalog = spark.createDataFrame([(i % 3, i) for i in range(30)], "cls int, func int")
    out = J.expand_classes(entries, catalog)
    assert out.rdd.getNumPartitions() == 8
    assert rows(out, "e", "class_pos", "cls", "func") == sorted((e, c - 1, c, i) for e in range(20) for c in (1, 2) for i in range(30) if i % 3 == c)


@pytest.mark.parametrize("small", [True, False])
def test_expanded_entries_and_functions_go_in_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(J, "TASK_ROWS", 400)
    monkeypatch.setattr(J, "BLOCK_BYTES", J.BLOCK_BYTES if small else 0)
    entries = [(1, [1, 2, 1]), (1, [1, 2, 1]), (None, [2, None, 3]), (2, []), (3, None), *[(k, [1]) for k in range(10, 90)]]
    functions = [(1, None), (1, 5), (1, 5), (2, 7), (None, 8), (4, 9), *[(1, k) for k in range(100, 400)]]
    out = J.expand_classes(spark.createDataFrame(entries, "e int, classes array<int>"), spark.createDataFrame(functions, "cls int, func int"))
    wanted = Counter((c, e, k, f) for e, cs in entries for k, c in enumerate(cs or []) for d, f in functions if c is not None and c == d)
    assert out.columns == ["cls", "e", "class_pos", "func"] and Counter(tuple(r) for r in out.collect()) == wanted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and any("_share" in x for x in plan.splitlines() if "Join Inner" in x) == (not small)


def test_phrases_meet_texts_without_moving_them(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Old files, old FILE"), (2, "a é thé bcd"), (3, ""), (4, None)], "id int, t string")
    rules = spark.createDataFrame([("old file", "of", 1), ("é t", "e", 2), ("a", "x", 3), ("old fox", "o", 4)], "pattern string, canonical string, ordinal int")
    there = R.phrase_hits(texts, "id", F.col("t"), rules, inline=0)
    monkeypatch.setattr(R, "INLINE_GRAMS", 0)
    moved = R.phrase_hits(texts, "id", F.col("t"), rules, inline=0)
    told = lambda d: rows(d.select("id", F.array_sort(F.col("hits.pattern"))))
    assert told(there) == told(moved) == [(1, ["old file"]), (2, ["a", "é t"]), (3, []), (4, [])]
    joined = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert (joined(there), joined(moved)) == (2, 3)


def test_hits_are_computed_once(spark):
    from wayfind.plans.join_plans import hit_rows

    texts = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("old file "), "id").alias("t"))
    rules = spark.createDataFrame([("file", "f", 1), ("2", "two", 2)], "pattern string, canonical string, ordinal int")
    out = hit_rows(R.phrase_hits(texts, "doc_id", F.col("t"), rules))
    assert "size(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == [(0, "file", "f"), (1, "file", "f"), (2, "2", "two"), (2, "file", "f")]


def test_queries_and_descriptions_of_exemplars_are_counted_once(spark):
    catalog = spark.createDataFrame(
        [("c", i, "a", "none", ["n"], ["same", f"w{i}", *["long"] * (i > 1)], ["p"], "cw") for i in range(6)]
        + [("d", 5, "a", "none", ["n"], ["lone", "lone"], ["p"], "cw"), ("e", 7, "a", "none", ["n"], None, ["p"], "cw"),
           ("e", 8, "a", "none", ["n"], ["same"], ["p"], "cw")],
        "cls string, func int, action string, target string, name_tokens array<string>, tokens array<string>, param_tokens array<string>, class_words string",
    )
    asked = [(i, "same green apple apple", i) for i in range(5)] + [(5, "same green pear", 2), (5, "apple pear same", 1), (8, "same green", 1), (9, None, 1)]
    mined = spark.createDataFrame(asked, "func int, query string, ord int")
    ranked = M.ranked_tokens(mined, "func", "ord", "query", X.tokenize(F.col("query")))
    lists = dict(rows(ranked, "func", "ranked"))
    assert lists == {**{i: ["apple", "same", "green"] for i in range(5)}, 5: ["pear", "same", "apple", "green"], 8: ["same", "green"]}
    assert rows(M.shared_tokens(catalog, "cls", F.array_distinct("tokens"))) == [("c", "same")]
    out = {(r.class_name, r.raw_name, r.variant): r.description for r in B.exemplars(catalog, mined, "ord").collect()}
    assert len(out) == 27
    assert out["c", 0, 1] == "a w0 w0 w0 cw" and out["c", 0, 3] == "a apple green apple green w0 cw"
    # A function of two classes leaves out the shared words of both.
    assert out["d", 5, 3] == "a pear apple green pear apple green lone lone cw"
    assert out["e", 8, 3] == "a same green same green same cw" and out["e", 7, 1] is None
    assert out["c", 2, 2] == "a n w2 long n w2 long cw"
