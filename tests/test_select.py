from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import evaluate as K
from wayfind.operators import metrics as M
from wayfind.operators import select as L
from wayfind.operators import sets as S

SCORES = "query int, candidate string, score double"


def test_gap_selection_edges(spark):
    df = spark.createDataFrame([
        (1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1), (1, "d", 0.09),   # c drops below a fifth of the best
        (2, "a", 0.0), (2, "b", -0.1),                                  # best is 0: nothing
        (3, "a", -0.5),                                                  # a lone candidate always counts
        (4, "a", 0.8), (4, "b", 0.8), (4, "c", 0.1),                    # tie, then a large gap
    ], SCORES)
    assert rows(L.select_gap(df).select("query", "candidate")) == [(1, "a"), (1, "b"), (3, "a"), (4, "a"), (4, "b")]


def test_ties_go_to_the_first_candidate(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.7)], SCORES)
    assert rows(L.top_k(df, 2).select("candidate", "rank")) == [("a", 2), ("c", 1)]


def test_narrow_falls_back_to_the_head_of_the_catalog(spark):
    scores = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.05)], SCORES)
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    head = spark.createDataFrame([("p", 1), ("q", 2)], "candidate string, ord int")
    assert rows(L.narrow(scores, queries, head, 2).select("query", "candidate")) == [(1, "x"), (2, "p"), (2, "q"), (3, "p"), (3, "q")]


def test_pattern_match_skips_empty_and_keeps_low_score(spark):
    df = spark.createDataFrame([(1, "[]__v1", 0.9), (1, "a|b__v2", 0.5), (2, "a__v1", 0.3)], SCORES)
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    out = L.match_pattern(df, queries, F.substring_index("candidate", "__v", 1))
    assert rows(out.select("query", F.coalesce("pattern", F.lit("-")), "score")) == [(1, "a|b", 0.5), (2, "-", 0.3), (3, "-", 0.0)]


def test_multisets_count_repeats(spark):
    pred = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "t int, f string")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "t int, f string")
    counted = S.counts(pred, truth, ["t"], "f")
    assert rows(S.set_equal(counted, ["t"])) == [(1, True), (2, True), (3, False)]
    assert rows(S.multiset_equal(counted, ["t"])) == [(1, False), (2, True), (3, False)]
    diff = S.multiset_diff(counted).select("t", "missing", "extra")
    assert rows(diff) == [(1, 0, 1), (2, 0, 0), (3, 1, 0)]
    only = S.path_accuracy(S.counts(pred.where("t = 1"), truth.where("t = 9"), ["t"], "f"), ["t"])
    assert rows(only.select("path_accuracy", "passed")) == [(1.0, True)]


def test_single_value_has_no_deviation_and_empty_ratio_is_zero(spark):
    df = spark.createDataFrame([(1, 2.5)], "g int, v double")
    assert rows(M.latency(df, ["g"], "v")) == [(1, 2.5, 0.0, 2.5)]
    assert spark.range(1).select(M.ratio(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_vote_ignores_none_and_prefers_the_first_seen(spark):
    df = spark.createDataFrame([(1, "none", 0), (1, "b", 1), (1, "a", 2), (2, "none", 3)], "g int, c string, o int")
    assert rows(M.vote(df, "g", "c", "o")) == [(1, "b"), (2, "none")]


def test_first_distinct_keeps_the_first_original(spark):
    df = spark.createDataFrame([("f", " Go ", 1), ("f", "go", 2), ("f", "Stay", 3), ("f", "x", 4)], "f string, q string, o int")
    assert rows(L.first_distinct(df, "f", "q", "o", 2)) == [("f", "Go", 1), ("f", "Stay", 2)]


def test_empty_truth_is_never_contained(spark):
    df = spark.createDataFrame([(1, "some text", ""), (2, "Some, TEXT!", "some text"), (3, "x", None)], "k int, r string, t string")
    assert rows(K.contains_any(df, "k", F.col("r"), F.col("t"))) == [(1, False), (2, True), (3, False)]


def test_composite_renormalises_over_present_sections(spark):
    cats = spark.createDataFrame([("live", "live", 0.5), ("agentic", "m", 1.0), ("agentic", "w", 0.0), ("agentic", "w", 0.5)], "section string, sub_section string, accuracy double")
    weights = spark.createDataFrame(list(M.SECTION_WEIGHTS.items()), "section string, weight double")
    overall, covered = M.composite(cats, weights).first()
    assert abs(overall - (0.5 * 0.1 + 0.625 * 0.4) / 0.5) < 1e-9 and abs(covered - 0.5) < 1e-9


def test_cost_bills_cached_input_at_its_own_rate(spark):
    prices = spark.createDataFrame([("a", 2.0, 10.0, 3.0, 0.5)], "tier string, p_in double, p_out double, p_cache_write double, p_cache_read double")
    use = spark.createDataFrame([("a", 100, 10, 5, 400, 1, 110)], "tier string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, api_calls long, total_tokens long")
    assert abs(M.cost(use, prices).first()["cost"] - (5 * 3 + 400 * 0.5 + 10 * 10) / 1e6) < 1e-12


def test_gap_and_merge_in_pieces(spark, monkeypatch):
    """The rules hold when a query's candidates are cut into pieces."""
    from wayfind.operators import scale, select

    data = [(q, c, float((q * 131 + c * 17) % 97) / 10 - 2.0) for q in (1, 2) for c in range(60)]
    scores = spark.createDataFrame(data, "query int, candidate int, score double")
    lists = [spark.createDataFrame([(1, f"{p}.n{k % 40}", float((k * 7) % 50 - 25)) for k in range(60)], "query int, candidate string, ord double") for p in "ab"]
    bare = F.substring_index("candidate", ".", -1)
    plain = rows(select.select_gap(scores, 0.9, 0.01)), rows(select.merge_candidates(lists, bare))
    real = scale.Ordered.__init__
    monkeypatch.setattr(scale.Ordered, "__init__", lambda self, df, keys, order, split_on, share=7, bound=None: real(self, df, keys, order, split_on, share, None))
    assert (rows(select.select_gap(scores, 0.9, 0.01)), rows(select.merge_candidates(lists, bare))) == plain


def test_a_response_meets_all_truths_of_its_key_at_once(spark):
    said = spark.createDataFrame([(1, 0, "The  Cat, sat"), (2, 0, "dog"), (3, 1, None), (4, 2, "x"), (5, 3, "y")], "k int, g int, r string")
    truths = spark.createDataFrame([(0, "mouse"), (0, "cat sat!"), (0, "!"), (1, "a"), (2, None), (0, "dogs")], "g int, t string")
    for block in (1, 2, 256):
        found = K.contains_any_of(said, truths, ["g"], "k", "r", "t", block)
        assert rows(found) == [(1, True), (2, False), (3, False), (4, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(_said") <= 1 and "lists" not in plan and "exists(_wanted" in plan
