import pytest
from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.functions import schema as S
from wayfind.functions import text as X
from wayfind.functions import vectors as V
from wayfind.operators import retrieval as P
from wayfind.operators import rules as R


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, value, expected", [
    (X.split_name, "getUserName_of.my-Thing", "get user name of my thing"),
    (X.tokenize, "Open log.txt, the LOG again x", ["open", "logtxt", "log", "again"]),
    (X.tokenize, "", []),
    (X.tokenize, "the a of", []),
    (X.tokenize_spaced, "Open log.txt", ["open", "log", "txt"]),
    (X.memory_tokens, "Mail bob@x.org about it's log.txt!", ["mail", "bob@x.org", "about", "it's", "log.txt"]),
    (X.generic_tokens, "the value of speed type", ["speed"]),
    (X.noun_tokens, "get the speed value", ["speed"]),
    (lambda c: X.bag(X.tokenize(c)), "red blue red", "red blue"),
    (lambda c: X.bag(X.tokenize(c)), "the of", "none"),
    (lambda c: X.bag_items(X.tokenize(c)), "the of", ["none"]),
    (lambda c: X.what_tokens(X.tokenize(c)), "show help", ["show", "help"]),
    (lambda c: X.what_tokens(X.tokenize(c)), "show speed", ["speed"]),
    (X.clean_description, "This tool belongs to x. Tool description: Returns the size", "size"),
    (X.clean_description, "this function, adds numbers", "adds numbers"),
    (X.query_params, "set 'a b' to 12 and \"q\"", ["q", "a b", "12", "set"]),
    (X.entities, "see 'x' in log.txt for @bob 3.5", ["x", "log.txt", "3.5", "bob"]),
    (X.clauses, "First part here. Second one; third piece, and then more text\n\nLast one", ["First part here.", "Second one", "third piece", "then more text", "Last one"]),
    (X.comparable, " Hello, Wörld! ", "hello wrld"),
    (X.tokenize, "café noir", ["caf", "noir"]),
    (C.call_name, "cd(folder='x')", "cd"),
    (C.call_name, "no call", "no call"),
    (C.call_args, "f(a='x y', n=3, a=4)", {"n": "3", "a": "4"}),
    (C.bare_name, "Files.cd", "cd"),
    (C.class_name, "cd", ""),
    (C.unvariant, "a|b__v12", "a|b"),
    (C.parse_calls, '```json\n{"f": "1"}\n```', [{"f": "1"}]),
    (C.parse_calls, "sorry", []),
    (C.expected_tools, '["f(a=1)", "g()"]', ["f", "g"]),
    (C.expected_tools, '[{"f": {"a": 1}}, {"f": {}}]', ["f"]),
    (C.expected_tools, "f(a=1)", ["f"]),
    (S.normal_type, "tuple", "array"),
    (S.normal_type, "unheard", "string"),
    (S.normal_type, None, "string"),
])
def test_functions(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


@pytest.mark.parametrize("value, kind, expected", [
    ("12", "integer", "12"), ("x", "integer", "x"), ("1.5", "float", "1.5"), ("", "boolean", "false"), ("a", "array", '["a"]'), ("a", "string", "a"),
])
def test_coerce(spark, value, kind, expected):
    df = spark.createDataFrame([(value, kind)], "v string, k string")
    assert df.select(S.coerce(F.col("v"), F.col("k"))).first()[0] == expected


def test_symbols_are_repeatable_and_bundles_keep_members_near(spark):
    df = spark.createDataFrame([("alpha",)], "t string")
    row = df.select(V.symbol(1, F.col("t"), 256).alias("a"), V.symbol(1, F.col("t"), 256).alias("b"), V.symbol(2, F.col("t"), 256).alias("c")).first()
    assert row.a == row.b and row.a != row.c and set(row.a) == {1, -1}
    near = df.select(V.cosine(V.bundle(1, F.array(F.col("t"), F.lit("beta"), F.lit("gamma")), 256), V.symbol(1, F.col("t"), 256)).alias("s")).first().s
    assert near > 0.3
    zero = spark.range(1).select(V.cosine(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1)))).first()[0]
    assert zero == 0.0


def test_a_text_is_lowered_once_for_all_its_rules(spark):
    rules = spark.createDataFrame([("ab", "x", 1), ("bc", "y", 2)], "pattern string, canonical string, ordinal int")
    texts = spark.createDataFrame([(1, "ABC"), (2, None), (3, "aBd")], "k int, t string")
    found = R.phrase_hits(texts, "k", F.col("t"), rules).select("k", F.transform("hits", lambda h: h["canonical"]).alias("c"))
    assert [(r.k, r.c) for r in found.orderBy("k").collect()] == [(1, ["x", "y"]), (2, []), (3, ["x"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan and "Contains(lower(" not in plan


def test_windows_get_the_words_of_their_clauses(spark):
    text = "The first clause here, and a second-clause; don't stop. Third clause follows now! the, of and to. A fifth one: it's e@mail.de, done"
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "only one clause"), (5, "The of and to the")], "k int, t string")
    want = P.encode_passages(P.document_windows(texts, "k", "t"), ["k", "pos"])
    got = P.encode_documents(texts, "k", "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3
