"""Tool calls linked with their results, ordered, checked and written as canonical JSON; SQL functions only.

Results are joined to calls by identifier.  Calls of a conversation are put in
topological order: the order they were made in, except that a call moves behind
what it depends on.  Arguments are checked against the tools' schemas.  Every
object is written without white space and with its keys in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import small_side, stored

SPAN = 4096


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _fits(kind: Column, wanted: Column) -> Column:
    """Whether a value's type, as Spark names it, is the JSON schema type ``wanted``."""
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return (
        F.when(wanted == "string", kind == "STRING")
        .when(wanted == "integer", kind == "BIGINT")
        .when(wanted == "number", (kind == "BIGINT") | number)
        .when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "array", kind.startswith("ARRAY"))
        .when(wanted == "object", kind.startswith("OBJECT"))
        .otherwise(F.lit(True))
    )


def with_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with ``arguments`` by the schema of ``name``, in a fixed order.

    ``schemas`` has a row (name, param, type, required) per parameter; a tool
    without parameters has one row with a null ``param``.
    """
    tools = schemas.where("name is not null").groupBy("name").agg(
        F.array_sort(F.collect_set(F.when(F.col("param").isNotNull(), F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required"))))).alias("_params")
    )
    df = calls.join(small_side(tools), "name", "left")
    # the type of each argument; null if the text is no JSON object
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    given = F.from_json("arguments", "map<string,variant>")
    df = df.withColumn("_types", F.when(is_object, F.transform_values(given, lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))))
    types, params = F.col("_types"), F.col("_params")
    empty = lambda t, p: (~F.map_contains_key(t, p.param)) | (F.element_at(t, p.param) == "VOID")
    missing = F.transform(F.filter(params, lambda p: p.required & empty(types, p)), lambda p: F.concat(F.lit("missing "), p.param))
    wrong = F.transform(
        F.filter(params, lambda p: ~empty(types, p) & ~_fits(F.element_at(types, p.param), p.type)),
        lambda p: F.concat(F.lit("not "), F.coalesce(p.type, F.lit("?")), F.lit(" "), p.param),
    )
    unknown = F.transform(
        F.array_sort(F.filter(F.map_keys(types), lambda k: ~F.exists(params, lambda p: p.param == k))),
        lambda k: F.concat(F.lit("unknown "), k),
    )
    errors = (
        F.when(params.isNull(), F.array(F.lit("no such tool")))
        .when(types.isNull(), F.array(F.lit("no object")))
        .otherwise(F.concat(missing, wrong, unknown))
    )
    return df.withColumn("errors", errors).drop("_params", "_types")


def topological_keys(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, id, at, hops) whose order keeps every call behind its dependencies, and (conv, id) on or behind a cycle.

    ``at`` is a position and ``hops`` the number of moves behind it.  Only calls
    made before what they depend on move, so there are as many rounds as the
    longest chain of such calls; none in a usual log.
    """
    edges = calls.select("conv", "id", F.explode("after").alias("dep")).where("dep is not null and dep <> id").distinct()
    keys = calls.groupBy("conv", "id").agg(F.min("pos").alias("at")).withColumn("hops", F.lit(0))
    edges = stored(edges.join(keys.select("conv", F.col("id").alias("dep")), ["conv", "dep"], "left_semi"))
    keys = stored(keys)
    sizes = calls.groupBy("conv").agg(F.countDistinct("id").alias("n"))
    while True:
        ahead = keys.select("conv", F.col("id").alias("dep"), F.struct("at", (F.col("hops") + 1).alias("hops")).alias("key"))
        pushed = edges.join(ahead, ["conv", "dep"]).groupBy("conv", "id").agg(F.max("key").alias("key"))
        moved = keys.join(pushed, ["conv", "id"]).where(F.col("key") > F.struct("at", "hops")).select("conv", "id", "key")
        moved = stored(moved.join(sizes, "conv").where("key.hops <= n").drop("n"))  # beyond: a cycle
        if not moved.limit(1).count():
            break
        keys = stored(
            keys.join(moved, ["conv", "id"], "left")
            .select("conv", "id", F.coalesce("key.at", "at").alias("at"), F.coalesce("key.hops", "hops").alias("hops"))
        )
    ahead = keys.select("conv", F.col("id").alias("dep"), F.struct("at", "hops").alias("key"))
    cyclic = (
        edges.join(ahead, ["conv", "dep"]).join(keys, ["conv", "id"])
        .where(F.col("key") >= F.struct("at", "hops")).select("conv", "id").distinct()
    )
    return keys, cyclic


def with_ordinal(df: DataFrame) -> DataFrame:
    """Add ``ordinal``, from 0 in each conversation, by at, hops, pos, id and arguments.

    Positions are cut into spans; a span is ordered by itself and starts after
    the counted rows of the spans before, so a long conversation is no single
    task's.
    """
    df = df.withColumn("_span", F.floor(F.coalesce("at", F.lit(-1)) / SPAN))
    before = Window.partitionBy("conv").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = df.groupBy("conv", "_span").agg(F.count(F.lit(1)).alias("_n")).select("conv", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("conv", "_span").orderBy(F.col("at").asc_nulls_last(), "hops", "pos", "id", "arguments")
    left = df.withColumn("_rank", F.row_number().over(inside) - 1)
    same = left["conv"].eqNullSafe(spans["conv"]) & (left["_span"] == spans["_span"])
    return left.join(spans, same).select(*[left[c] for c in df.columns if c != "_span"], (F.col("_skip") + F.col("_rank")).cast("bigint").alias("ordinal"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, every_result: bool = False) -> DataFrame:
    """One row per call: conv, id, ``ordinal``, ``valid``, ``errors`` and ``message``; then results without a call.

    ``calls``: conv, id, pos, name, arguments (JSON text), after (ids it depends
    on).  ``results``: conv, id, content.  Other columns are left out.  Of
    several results with one id the least content is linked; the others keep a
    row each if ``every_result``, with the error ``repeated result``.  Repeated calls keep a row
    each, with the error ``repeated id``.  Null conversations are one
    conversation.  A call without id is never linked (``no id``) and has the
    place of its position.  A result without a call has a null ordinal and the
    error ``no call``, and so has each result without id if
    ``every_result``.  Dependencies on
    unknown ids, on the call itself or around a cycle are errors and don't order.
    """
    conv = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    calls = calls.select(
        F.col("conv").alias("_conv"), conv.alias("conv"), F.col("id").cast("string").alias("id"), F.col("pos").cast("bigint").alias("pos"),
        "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"),
    )
    given = results.select(F.col("conv").alias("_conv2"), conv.alias("conv"), F.col("id").cast("string").alias("id"), "content")
    answers = given.groupBy("conv", "id").agg(F.first("_conv2").alias("_conv2"), F.min("content").alias("content")).withColumn("answered", F.lit(True))
    # what is left of equal ids: all results but one copy of the linked content
    counted = given.groupBy("conv", "id", "content").agg(F.first("_conv2").alias("_conv2"), F.count(F.lit(1)).alias("n"))
    low = answers.select(F.col("conv").alias("_c"), F.col("id").alias("_i"), F.col("content").alias("_low"))
    counted = counted.join(low, F.col("conv").eqNullSafe(F.col("_c")) & F.col("id").eqNullSafe(F.col("_i")))
    spare = F.col("n") - F.col("content").eqNullSafe(F.col("_low")).cast("int")
    again = counted.where(spare > 0).select("conv", "id", "_conv2", "content", F.explode(F.sequence(F.lit(1).cast("bigint"), spare)).alias("_copy")).drop("_copy")
    keys, cyclic = topological_keys(calls.where("id is not null"))
    known = calls.where("id is not null").groupBy("conv", "id").agg(F.count(F.lit(1)).alias("copies"))
    checked = with_errors(calls, schemas)
    wanted = checked.select("conv", "id", F.explode("after").alias("dep")).where("id is not null and dep is not null and dep <> id")
    lost = (
        wanted.distinct().join(known.select("conv", F.col("id").alias("dep")), ["conv", "dep"], "left_anti")
        .groupBy("conv", "id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown dependency "), "dep"))).alias("lost"))
    )
    df = (
        checked.join(known, ["conv", "id"], "left").join(keys, ["conv", "id"], "left")
        .join(lost, ["conv", "id"], "left").join(cyclic.withColumn("cyclic", F.lit(True)), ["conv", "id"], "left")
    )
    df = df.withColumn("at", F.coalesce("at", "pos")).withColumn("hops", F.coalesce("hops", F.lit(0)))
    one = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("errors", F.concat(
        one(F.col("id").isNull(), "no id"), one(F.col("copies") > 1, "repeated id"), F.col("errors"),
        one(F.array_contains("after", F.col("id")), "depends on itself"),
        F.coalesce("lost", F.array().cast("array<string>")), one(F.col("cyclic"), "depends on a cycle"),
    ))
    df = with_ordinal(df.select("_conv", "conv", "id", "pos", "name", "arguments", "at", "hops", "errors"))
    both = df.withColumn("called", F.lit(True)).join(answers, ["conv", "id"], "full")
    both = both.withColumn("errors", F.when(F.col("called").isNull(), F.array(F.lit("no call"))).otherwise(F.col("errors")))
    again = again.withColumn("errors", F.array(F.when(F.col("id").isNull(), "no call").otherwise("repeated result")))
    both = both.unionByName(again, allowMissingColumns=True) if every_result else both
    message = F.to_json(F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null"))).alias("arguments"),
        "errors", "id", "name", F.col("ordinal"), F.col("content").alias("result"),
    ), {"ignoreNullFields": "false"})
    return both.select(
        F.coalesce("_conv", "_conv2").alias("conv"), "id", "ordinal",
        (F.size("errors") == 0).alias("valid"), "errors", message.alias("message"),
    )


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that a table of plain turns stands for.

    A user turn calls a tool chosen by its length, some with faulty arguments; an
    assistant turn is the result of the turn before.  Of two user turns two apart
    the later depends on the earlier, or the other way round where the earlier's
    length is a multiple of 11.
    """
    user = conversations.where("role = 'user'")
    n = F.coalesce(F.length("text"), F.lit(0))
    keep = {"ignoreNullFields": "false"}
    query = F.col("text")
    search = F.when(n % 5 == 0, F.to_json(F.struct(query.alias("query"), n.cast("string").alias("limit")), keep)).otherwise(
        F.to_json(F.struct(query.alias("query"), n.alias("limit")), keep))
    lookup = F.when(n % 7 == 0, F.to_json(F.struct((n > 99).alias("exact")))).otherwise(
        F.to_json(F.struct(query.alias("key"), (n > 99).alias("exact")), keep))
    note = F.when(n % 4 == 0, F.to_json(F.struct(query.alias("text"), F.lit(1).alias("extra")), keep)).otherwise(F.to_json(F.struct(query.alias("text")), keep))
    turns = user.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.concat(F.lit("call_"), F.col("turn")).alias("id"),
        F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("note").alias("name"),
        F.when(n % 3 == 0, search).when(n % 3 == 1, lookup).otherwise(note).alias("arguments"),
        (n % 11 == 0).alias("behind"),
    )
    at = turns.select("conv", "pos", "behind").groupBy("conv", "pos").agg(F.max("behind").alias("behind"))
    earlier = at.select("conv", (F.col("pos") + 2).alias("pos"), F.col("behind").alias("earlier"))
    later = at.select("conv", (F.col("pos") - 2).alias("pos"), F.lit(True).alias("later"))
    calls = turns.join(earlier, ["conv", "pos"], "left").join(later, ["conv", "pos"], "left").select(
        "conv", "pos", "id", "name", "arguments",
        F.array_compact(F.array(
            F.when(~F.col("earlier"), F.concat(F.lit("call_"), F.col("pos") - 2)),
            F.when(F.col("later") & F.col("behind"), F.concat(F.lit("call_"), F.col("pos") + 2)),
        )).alias("after"),
    )
    results = conversations.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), F.concat(F.lit("call_"), F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame(
        [("search", "query", "string", True), ("search", "limit", "integer", False), ("lookup", "key", "string", True),
         ("lookup", "exact", "boolean", False), ("note", "text", "string", True)],
        "name string, param string, type string, required boolean",
    )
    return calls, results, schemas
