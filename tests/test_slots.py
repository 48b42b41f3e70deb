import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import slots as V


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, text, expected", [
    (lambda t: V.anchor_number(t, "base", F.lit(True)), "a base of 10", "10"),
    (lambda t: V.anchor_number(t, F.lit("base_len"), F.lit(True)), "use 4 for len", "4"),
    (lambda t: V.anchor_number(t, "x", F.lit(False)), "x=-2", "-2.0"),
    (lambda t: V.anchor_number(t, "y", F.lit(True)), "nothing", None),
    (lambda t: V.enum_match(t, F.array(F.lit("kilo"), F.lit("meter"))), "in METERS", "meter"),
    (lambda t: V.enum_match(t, F.array(F.lit("kilogram"), F.lit("zz"))), "a gram", "kilogram"),
    (lambda t: V.bool_value(t, F.lit("dry_run"), F.lit("x")), "run is no", "false"),
    (lambda t: V.bool_value(t, F.lit("dry_run"), F.lit("x")), "a dry run", "true"),
    (lambda t: V.bool_value(t, F.lit("dry_run"), F.lit("x")), "go", "x"),
    (lambda t: V.array_value(t, F.lit("integer")), "1, 2.7 and 3", ["1", "2", "3"]),
    (lambda t: V.array_value(t, F.lit("string")), 'take "a" and "b"', ["a", "b"]),
    (V.string_value, "Say 'hi' to Bob", "hi"),
    (V.string_value, "Tell Émile3 and Zoë", "Zoë"),
    (lambda t: V.strategy("quoted_filtered:s", t, {"s": F.array(F.lit("a"))}, {}), "'a' 'b'", "b"),
    (lambda t: V.strategy("positional_after_transfer", t, {}, {}), "move 'a' to 'b' and 'c'", "b"),
    (lambda t: V.strategy("positional_before_transfer", t, {}, {}), "move 'x' 'a' into 'b'", "a"),
    (lambda t: V.strategy("implicit_single:s", t, {"s": F.array(F.lit("a"), F.lit("b"))}, {}), "", None),
    (lambda t: V.strategy("fallback_words", t, {}, {"up": "..", "here": "."}), "go here", "."),
])
def test_values(spark, fn, text, expected):
    assert one(spark, text, fn) == expected


def test_passes_in_order(spark):
    schema = (V.Param("base", "integer"), V.Param("height", "number"), V.Param("city", "string"), V.Param("note", "string", required=False))
    df = spark.createDataFrame([(1, "area with base 3 and 7 near Rome")], "k int, t string")
    out = rows(V.extract_args(df, "k", "t", schema).select("param", "value", "pass"))
    # The position counts all numbers of the text, also one that is used already.
    assert out == [("base", "3", "named"), ("city", "Rome", "fallback"), ("height", "3.0", "positional")]


def test_accuracy_classes(spark):
    truth = spark.createDataFrame([(1, "f", "a", "1"), (1, "f", "b", "2"), (2, "f", "a", "9"), (3, "g", "_0", "x")], "k int, func string, param string, value string")
    filled = spark.createDataFrame([(1, "a", "1"), (1, "b", "0"), (2, "a", "9")], "k int, param string, value string")
    assert rows(V.slot_accuracy(filled, truth, "k", "func")) == [("f", 2, 1, 1, 0)]


def asked(spark, n=1):
    text = "Move 'a.txt' to \"d\", depth is 3, verbose is no and 4 for Speed"
    return spark.range(n).select(F.lit(7).alias("k"), F.concat(F.lit(text), F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("t"), F.array(F.lit("a.txt")).alias("items"))


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Join")


def test_known_and_row_schema_agree(spark):
    schema = (V.Param("depth", "integer"), V.Param("top_speed", "number"), V.Param("verbose", "boolean"), V.Param("kind", enum=("Moved", "Copied")),
              V.Param("left", "integer"), V.Param("list", "array", item_type="integer"))
    s = lambda v: F.lit(v).cast("string")
    column = F.array(*[F.struct(s(p.name).alias("name"), s(p.type).alias("type"), (F.array(*[F.lit(e) for e in p.enum]) if p.enum else F.lit(None).cast("array<string>")).alias("enum"),
                                s(p.item_type).alias("item_type"), s(p.default).alias("default"), F.lit(p.required).alias("required")) for p in schema]).cast(V.SCHEMA)
    known = rows(V.extract_args(asked(spark), "k", "t", schema))
    assert known == rows(V.extract_args(asked(spark).withColumn("schema", column), "k", "t", "schema"))
    assert [r[1:] for r in known] == [("depth", "3", "named"), ("kind", "Moved", "named"), ("left", "3", "positional"), ("list", '["3","4"]', "named"),
                                      ("top_speed", "4.0", "named"), ("verbose", "false", "named")]


def test_a_pattern_is_looked_for_once(spark):
    plan = V.extract_args(asked(spark), "k", "t", (V.Param("depth", "integer"),))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2  # after and before the name


def test_bool_value_by_a_plain_name_has_literal_patterns(spark):
    for name, default in (("dry_run", "x"), ("verbose", None), ("by_rail", "false"), ("is_verbose", "true")):
        for text in ("run is no", "a dry run", "go", "VERBOSE=yes", "verbose", "by rail", ""):
            default_ = F.lit(default).cast("string")
            assert one(spark, text, lambda t: V.bool_value(t, name, default_)) == one(spark, text, lambda t: V.bool_value(t, F.lit(name), default_))


def test_slots_in_the_row_need_no_join(spark):
    slots = {"from": {"strategies": ["quoted:0"]}, "to": {"strategies": ["positional_after_transfer"]}, "none": {"strategies": ["quoted:9"]}}
    filled = V.with_slots(asked(spark, 2), "t", slots, {"items": F.col("items")})
    assert rows(filled, "filled") == [(("a.txt", "d", None),)] * 2
    done = filled.select(*[V.complete(F.array(*[F.lit(x) for x in r]), F.col("filled"), slots) for r in (["from", "to"], ["from", "none"], ["other"])])
    assert rows(done) == [(True, False, False)] * 2 and joins(done) == 0
    # Two equal calls are two calls.
    calls = V.accuracy_of_rows(filled, "k", {"from": F.lit("a.txt"), "to": F.lit("e")}, F.col("filled"))
    assert rows(calls) == [(7, 2, 0, 2, 0)] and joins(calls) == 0


def test_hints_read_the_text_once(spark):
    params = [V.Param("file"), V.Param("folder"), V.Param("content"), V.Param("n", "integer"), V.Param("x")]
    hints = V.param_hints(asked(spark), "k", "t", params)
    assert rows(hints) == [(7, "content", "a.txt"), (7, "file", "a.txt"), (7, "folder", "d"), (7, "n", "3")]
    assert hints._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


def test_trigger_words_are_whole_tokens(spark):
    for text in ("go Up now", "upper", "set-up", "up", "", "a/up", "-up", "ups up", "a.b", "é up"):
        for words in ({"up": "1"}, {"a.b": "1"}, {"": "1"}, {"x": "0", "up": "2"}):
            tokens = re.split(r"[^a-z0-9_\-]+", text.lower())
            want = next((v for w, v in words.items() if w in tokens), None)
            assert one(spark, text, lambda t: V.strategy("keyword_map", t, {}, words)) == want
            assert one(spark, text, lambda t: V.strategy("bool_triggers", t, {}, words)) == (want and "true")
