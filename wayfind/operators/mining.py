"""Mine exemplars, patterns and tests from labelled conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.functions import calls as C
from wayfind.functions import schema as SC
from wayfind.functions import text as X
from wayfind.operators import metrics as M
from wayfind.operators import select as L
from wayfind.operators.scale import Ordered, hold_if_small, join_lookup

LONG_TURN = 4_096


def mine_queries(queries: DataFrame, calls: DataFrame, turn: Sequence[str], call: str) -> DataFrame:
    """One ``(func, query)`` row per expected call of a turn with a user query."""
    named = calls.withColumn("func", C.call_head(F.col(call)))
    return join_lookup(named, queries.where(F.length("query") > 0), turn)


def exemplar_intent(functions: DataFrame, class_map: DataFrame, global_map: DataFrame) -> DataFrame:
    """Action and target: from the class map, else the global map, else ``none``."""
    own = class_map.select("cls", "func", F.col("action").alias("_ca"), F.col("target").alias("_ct"))
    shared = global_map.select("func", F.col("action").alias("_ga"), F.col("target").alias("_gt"))
    df = join_lookup(join_lookup(functions, own, ["cls", "func"], "left"), shared, ["func"], "left")
    in_class = F.col("_ca").isNotNull()
    return df.select(
        *functions.columns,
        F.when(in_class, F.col("_ca")).otherwise(F.coalesce("_ga", F.lit("none"))).alias("action"),
        F.when(in_class, F.col("_ct")).otherwise(F.coalesce("_gt", F.lit("none"))).alias("target"),
    )


def differing_words(catalog: DataFrame, cls: str, tokens: str, fallback: int | None = None) -> DataFrame:
    """Description tokens that are not shared by the whole class.

    Falls back to (the first ``fallback``) tokens.  The shared tokens of a class are at
    most the tokens of one description.
    """
    shared = M.shared_tokens(catalog, cls, F.array_distinct(tokens)).groupBy(cls).agg(F.collect_list("token").alias("_shared"))
    df = join_lookup(catalog, checkpointed(shared), [cls], "left")
    common = F.coalesce("_shared", F.array().cast("array<string>"))
    own = X.let(
        F.filter(tokens, lambda w: ~F.array_contains(common, w)),
        lambda d: F.when(F.size(d) > 0, d).otherwise(X.leading(F.col(tokens), fallback)),
    )
    return df.withColumn("diff", F.when(F.col("_shared").isNull(), F.col(tokens)).otherwise(own))


def _words(*parts: Column) -> Column:
    return F.concat(*[p if i == 0 else F.concat(F.lit(" "), p) for i, p in enumerate(parts)])


def exemplars(catalog: DataFrame, mined: DataFrame, order: str, fallback: int | None = None, params: int | None = None,
              top: Sequence[int | None] = (None, None, None)) -> DataFrame:
    """Three exemplars per function.

    ``catalog(cls, func, action, target, name_tokens, tokens, param_tokens,
    class_words)``, ``mined(func, query, order)``.  Variant 1 repeats the differing
    words, variant 2 name and differing words, variant 3 the frequent words of
    mined queries or, without any, (the first ``params``) parameter words.  ``top``
    holds the limits of :func:`metrics.top_tokens`.
    """
    df = differing_words(catalog, "cls", "tokens", fallback)
    first, cut, keep = top
    own = df.where(F.col("_shared").isNotNull()).groupBy("func").agg(F.flatten(F.collect_set("_shared")).alias("_own"))
    # The catalog moves to the functions' tokens as joined words: an array takes several times their bytes.
    both = F.array_join(F.array_distinct(F.concat("name_tokens", "diff")), " ")
    df = df.withColumns({"_diff": F.array_join("diff", " "), "_both": both}).drop("diff", "tokens", "_shared")
    ranked = M.ranked_tokens(mined, "func", order, "query", X.tokenize(F.col("query")), first, cut)
    df = df.join(ranked.join(own, "func", "left"), "func", "left")
    unshared = F.when(F.col("_own").isNull(), F.col("ranked")).otherwise(F.filter("ranked", lambda w: ~F.array_contains("_own", w)))
    df = df.withColumn("_mined", X.leading(unshared, keep))
    diff, both = F.col("_diff"), F.col("_both")
    mined_words = F.array_join("_mined", " ")
    named = F.array_join(X.leading(F.col("param_tokens"), params), " ")
    repeated = _words(F.col("action"), diff, diff, diff, F.col("class_words"))
    second = _words(F.col("action"), both, both, F.col("class_words"))
    third = F.when(F.size("_mined") > 0, _words(F.col("action"), mined_words, mined_words, diff, F.col("class_words"))).otherwise(
        _words(F.col("action"), named, diff, diff, F.col("class_words"))
    )
    variants = F.array(*[
        F.struct(F.lit(i).alias("variant"), d.alias("description")) for i, d in ((1, repeated), (2, second), (3, third))
    ])
    return df.select(
        F.col("cls").alias("class_name"), C.qualify(F.col("cls"), F.col("func").cast("string")).alias("function_name"),
        F.col("func").alias("raw_name"), "action", "target",
        X.bag(F.col("name_tokens")).alias("function_name_bow"), X.bag(F.col("param_tokens")).alias("parameters_bow"),
        F.explode_outer(variants).alias("v"),
    ).select("class_name", "function_name", "raw_name", "action", "target", "function_name_bow", "parameters_bow",
             "v.variant", "v.description")


def test_pairs(mined: DataFrame, order: str, n: int = 20) -> DataFrame:
    """Up to ``n`` distinct queries per function."""
    return L.first_distinct(mined, "func", "query", order, n).select("query", F.col("func").alias("expected_function"), F.lit("mined").alias("test_type"))


def turn_patterns(turns: DataFrame, calls: DataFrame, turn: Sequence[str], func: str, order: Sequence[str],
                  split_on: Column, long_turn: int = LONG_TURN) -> DataFrame:
    """Turns with their pattern: ordered function names as ``a|b|c``, ``[]`` for none.

    The names of a turn with more than ``long_turn`` calls are joined in blocks of
    that many, and the blocks in order: the pattern has one form at every size.
    """
    turn = list(turn)
    named = calls.select(*turn, *order, F.col(func).alias("_f"), split_on.alias("_at"))
    sizes = named.groupBy(*turn).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.where(F.col("_n") > long_turn)
    short = named
    blocks = None
    if not long.isEmpty():
        many = named.join(long, turn)
        short = named.join(long.select(*turn), turn, "left_anti")
        placed = Ordered(many, turn, order, F.col("_at")).row_number("_pos").result()
        part = F.array_sort(F.collect_list(F.struct("_pos", "_f")))
        blocks = placed.groupBy(*turn, F.floor((F.col("_pos") - 1) / long_turn).alias("_block")).agg(
            F.array_join(F.transform(part, lambda r: r["_f"]), "|").alias("_text")
        )
        parts = F.array_sort(F.collect_list(F.struct("_block", "_text")))
        blocks = blocks.groupBy(*turn).agg(F.array_join(F.transform(parts, lambda r: r["_text"]), "|").alias("pattern"))
    rows = F.array_sort(F.collect_list(F.struct(*order, "_f")))
    keyed = short.groupBy(*turn).agg(F.array_join(F.transform(rows, lambda r: r["_f"]), "|").alias("pattern"))
    if blocks is not None:
        keyed = keyed.unionByName(blocks)
    return turns.join(keyed, turn, "left").withColumn("pattern", F.coalesce("pattern", F.lit(L.EMPTY_PATTERN)))


def mine_patterns(turns: DataFrame, order: str) -> DataFrame:
    """Patterns with their number of turns, of distinct queries, and first query."""
    norm = F.lower(F.trim("query"))
    return turns.where(F.length(F.trim("query")) > 0).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct(norm).alias("queries"), F.min_by("query", order).alias("first_query"),
    )


def pattern_words(pattern: Column) -> Column:
    """Distinct words of a pattern's function names; ``none`` when it is empty."""
    words = X.split_space(X.split_name(F.replace(pattern, F.lit("|"), F.lit(" "))))
    return F.when(pattern == L.EMPTY_PATTERN, "none").otherwise(X.bag(words))


def pattern_exemplars(turns: DataFrame, order: str, votes: DataFrame, variants: int | None = None, split_on: Column | None = None) -> DataFrame:
    """Exemplars of every pattern.

    ``turns(pattern, query, order, action, target, domain)``.  Variant 1 describes
    the first query, variant 2 the functions, variants from 3 on all
    (the first ``variants``) distinct queries.  ``votes(pattern, domain)`` holds the voted domain.
    ``split_on`` is a number that never falls in the order of ``candidate_order`` (``order`` of
    a query's first turn); without it, ``order`` is one.
    """
    split_on = F.col("candidate_order") if split_on is None else split_on
    valid = turns.where(F.length(F.trim("query")) > 0)
    firsts = valid.groupBy("pattern").agg(F.min_by(F.struct("query", "action", "target"), order).alias("f"))
    base = firsts.join(votes, "pattern").select("pattern", "f.query", "f.action", "f.target", "domain")
    words = pattern_words(F.col("pattern"))

    def described(df: DataFrame, variant: Column) -> DataFrame:
        bag = X.bag(X.pattern_tokens(F.col("query")))
        own = F.when(bag == "none", F.when(variant == 1, words).otherwise("none")).otherwise(bag)
        text = F.when(words != "none", F.concat(own, F.lit(" "), words)).otherwise(own)
        return df.select("pattern", "action", "target", "domain", words.alias("function_name_bow"),
                         X.bag(X.pattern_params(F.col("query"))).alias("parameters_bow"),
                         text.alias("description"), variant.cast("int").alias("variant"))

    heavy = F.concat_ws(
        " ",
        F.when(F.col("action") != "none", F.replace("action", F.lit("_"), F.lit(" "))),
        F.when(words != "none", words).otherwise("empty"),
        F.when(F.col("domain") != "none", F.col("domain")),
    )
    second = base.select("pattern", "action", "target", "domain", words.alias("function_name_bow"),
                         X.bag(X.pattern_params(F.col("query"))).alias("parameters_bow"),
                         heavy.alias("description"), F.lit(2).alias("variant"))
    norm = F.lower(F.trim("query")).alias("_norm")
    distinct = valid.groupBy("pattern", norm).agg(
        F.min_by(F.struct("query", "action", "target", "domain"), order).alias("q"), F.min(order).alias("candidate_order")
    ).select("pattern", "candidate_order", "q.query", "q.action", "q.target", "q.domain")
    if variants is None:  # a pattern's queries may be any number: they are numbered in pieces
        kept = Ordered(distinct, ["pattern"], ["candidate_order"], split_on).row_number("rank").result().withColumn("rank", F.col("rank").cast("int"))
    else:
        ranked = distinct.withColumn("score", F.lit(0.0)).withColumnRenamed("pattern", "_p")
        placed = ranked.withColumn("rank", F.row_number().over(L.by_score("_p", "candidate_order")))
        kept = placed.where(F.col("rank") <= variants).withColumnRenamed("_p", "pattern")
    return described(base, F.lit(1)).unionByName(second).unionByName(described(kept, F.col("rank") + 2))


def task_exemplars(turns: DataFrame, classes: DataFrame) -> DataFrame:
    """Turns with calls as tasks; the class comes from the first known function.

    ``turns(entry, turn, query, functions, involved)``, ``classes(func, cls)``.
    """
    placed = turns.where(F.size("functions") > 0).select("entry", "turn", F.posexplode("functions").alias("pos", "func"))
    known = join_lookup(placed, classes, ["func"]).groupBy("entry", "turn").agg(F.min_by("cls", "pos").alias("_cls"))
    df = turns.where(F.size("functions") > 0).join(known, ["entry", "turn"], "left")
    fallback = F.coalesce(F.get("involved", F.lit(0)), F.lit("unknown"))
    return df.select(
        "entry", "turn", "query", X.clean_query(F.col("query")).alias("query_clean"),
        F.array_join("functions", ",").alias("pattern"), F.coalesce("_cls", fallback).alias("cls"),
    )


TASK_THRESHOLD = 0.20


def task_sequence(best: DataFrame, tasks: DataFrame, threshold: float = TASK_THRESHOLD) -> DataFrame:
    """Function sequence of the most similar task; none below the threshold.

    ``best(query, candidate, score)`` with one row per query.
    """
    names = tasks.select(F.col("task").alias("candidate"), "functions")
    joined = names.join(hold_if_small(best), "candidate")
    return joined.select("query", F.when(F.col("score") >= threshold, F.col("functions")).alias("functions"), "score")
