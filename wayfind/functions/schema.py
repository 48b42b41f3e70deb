"""Parameter schemas: ``MAP<name, STRUCT<type, description, enum, default>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.functions import text as X
from wayfind.functions import words as W

PROPERTIES = (
    "map<string,struct<type:string,description:string,enum:array<string>,default:string>>"
)


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def param_tokens(props: Column, with_type: bool = True, enums: int | None = None) -> Column:
    """Tokens of every parameter: name, (the first ``enums``) enum values, description, type."""

    def of_one(entry: Column) -> Column:
        spec = entry["value"]
        enum = F.flatten(F.transform(X.leading(spec["enum"], enums), lambda v: X.tokenize(v)))
        parts = [
            X.split_space(X.split_name(entry["key"])),
            F.coalesce(enum, _no_tokens()),
            F.coalesce(X.tokenize(spec["description"]), _no_tokens()),
        ]
        if with_type:
            telling = spec["type"].isNotNull() & ~spec["type"].isin("", *W.TRIVIAL_TYPES)
            parts.append(F.when(telling, F.array(spec["type"])).otherwise(_no_tokens()))
        return F.concat(*parts)

    return X.without(F.flatten(F.transform(F.map_entries(props), of_one)), W.STOP_WORDS)


def param_names(props: Column, words: int | None = None) -> Column:
    """Name tokens of all parameters, then (the first ``words``) words of each description."""
    entries = F.map_entries(props)
    names = F.flatten(F.transform(entries, lambda e: X.split_space(X.split_name(e["key"]))))
    described = F.flatten(
        F.transform(
            entries,
            lambda e: F.coalesce(X.leading(X.generic_tokens(e["value"]["description"]), words), _no_tokens()),
        )
    )
    return X.without(F.concat(names, described), W.STOP_WORDS + W.GENERIC_WORDS)


def param_types(props: Column) -> Column:
    return F.transform(F.map_values(props), lambda s: F.coalesce(s["type"], F.lit("string")))


def param_entities(props: Column, words: int | None = None, enums: int | None = None) -> Column:
    """(The first) description words, enum values and the default of each parameter."""

    def of_one(spec: Column) -> Column:
        return F.concat(
            F.coalesce(X.leading(X.tokenize(spec["description"]), words), _no_tokens()),
            F.coalesce(F.transform(X.leading(spec["enum"], enums), F.lower), _no_tokens()),
            F.when(spec["default"].isNotNull(), F.array(F.lower(spec["default"]))).otherwise(_no_tokens()),
        )

    return F.flatten(F.transform(F.map_values(props), of_one))


def normal_type(col: Column) -> Column:
    """Schema type name in its normal form; unknown or missing is ``string``."""
    expr = F.lit("string")
    by_target: dict[str, list[str]] = {}
    for source, target in W.TYPE_NAMES.items():
        by_target.setdefault(target, []).append(source)
    for target, sources in by_target.items():
        if target != "string":
            expr = F.when(col.isin(sources), F.lit(target)).otherwise(expr)
    return expr


SPEC = "struct<type:string,properties:map<string,string>,items:struct<type:string>>"


def nested_types(df: DataFrame, key: str, spec: str) -> DataFrame:
    """Normal type of every property of JSON schemas: ``(key, path, type_name)``.

    ``spec`` holds ``{name: {type, properties, items}}`` as JSON text.  Inside
    arrays and objects their properties are visited level by level, as far as
    there are any; without properties the type of ``items`` is given as
    ``path.items``.
    """
    level = df.select(key, F.lit("").alias("_above"), F.from_json(spec, "map<string,string>").alias("_props"))
    found = None
    while True:
        one = level.select(key, "_above", F.explode("_props").alias("_name", "_text"))
        one = one.select(key, F.concat("_above", "_name").alias("path"), F.from_json("_text", SPEC).alias("_s"))
        typed = checkpointed(one.withColumn("type_name", normal_type(F.col("_s.type"))))
        if typed.isEmpty():
            return found if found is not None else typed.select(key, "path", "type_name")
        inside = typed.where(F.col("type_name").isin("array", "object"))
        items = inside.where(F.col("_s.properties").isNull() & F.col("_s.items").isNotNull())
        rows = typed.select(key, "path", "type_name").unionByName(
            items.select(key, F.concat("path", F.lit(".items")).alias("path"), normal_type(F.col("_s.items.type")).alias("type_name"))
        )
        found = rows if found is None else found.unionByName(rows)
        level = inside.select(key, F.concat("path", F.lit(".")).alias("_above"), F.col("_s.properties").alias("_props"))


def coerce(value: Column, type_name: Column) -> Column:
    """Text form of a value cast to its schema type; the raw text if that fails."""
    integer = F.when(value.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(value).cast("bigint").cast("string"))
    number = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(value).cast("double").cast("string"))
    truth = F.when(F.length(value) > 0, F.lit("true")).otherwise("false")
    listed = F.when(F.startswith(F.trim(value), F.lit("[")), value).otherwise(
        F.concat(F.lit('["'), value, F.lit('"]'))
    )
    typed = (
        F.when(type_name.isin("integer", "int"), integer)
        .when(type_name.isin("number", "float"), number)
        .when(type_name == "boolean", truth)
        .when(type_name == "array", listed)
        .otherwise(value)
    )
    return F.coalesce(typed, value)
