"""Call strings, qualified names and call payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.functions import text as X


def call_name(col: Column) -> Column:
    """``f(a='x')`` -> ``f``; a string without a call form stays as it is."""
    name = F.regexp_extract(col, r"^(\w+)\(", 1)
    return F.when(name != "", name).otherwise(col)


def call_head(col: Column) -> Column:
    """Everything before the first parenthesis, trimmed."""
    return X.strip(F.substring_index(col, "(", 1))


def call_args(col: Column) -> Column:
    """Keyword arguments as a string map: quoted strings, then integers.

    An integer argument replaces a string argument of the same name.
    """
    body = F.regexp_extract(col, r"(?s)^\w+\((.*)\)", 1)
    quoted = r"(\w+)='([^']*)'"
    integer = r"(\w+)=(\d+)"

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(
            X.find_all(body, pattern, 1).alias("k"), X.find_all(body, pattern, 2).alias("v")
        )

    both = F.concat(
        F.transform(pairs(quoted), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))),
        F.transform(pairs(integer), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))),
    )
    latest = F.filter(
        both,
        lambda p, i: ~F.exists(
            F.slice(both, i + 2, F.size(both)), lambda later: later["k"] == p["k"]
        ),
    )
    return F.map_from_entries(latest)


def format_call(name: Column, strings: Column, plain: Column) -> Column:
    """``f(k='v', n=1)`` from a map of string and a map of unquoted values."""
    quoted = F.transform(F.map_entries(strings), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'")))
    bare = F.transform(F.map_entries(plain), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.lit("("), F.array_join(F.concat(quoted, bare), ", "), F.lit(")"))


def bare_name(col: Column) -> Column:
    """``Class.func`` -> ``func``."""
    return F.substring_index(col, ".", -1)


def class_name(col: Column) -> Column:
    """``Class.func`` -> ``Class``; empty when there is no class."""
    return F.when(F.contains(col, F.lit(".")), F.substring_index(col, ".", 1)).otherwise("")


def unvariant(col: Column) -> Column:
    """Name without its exemplar variant: cut at the first ``__v``."""
    return F.substring_index(col, "__v", 1)


def restore_dotted(col: Column, known: Column) -> Column:
    """Replace an underscore form by the dotted name it came from."""
    return F.when(F.replace(known, F.lit("."), F.lit("_")) == col, known).otherwise(col)


def qualify(cls: Column, name: Column) -> Column:
    """Prefix a name with its class unless it already carries one."""
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(cls, F.lit("."), name))


CALL_LIST = "array<map<string,string>>"


def parse_calls(col: Column) -> Column:
    """Calls of a JSON answer: code fences off; one object counts as a list.

    Text that is no JSON gives an empty list.
    """
    body = X.strip(F.regexp_replace(X.strip(col), r"^```[a-zA-Z]*|```$", ""))
    listed = F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return F.coalesce(F.from_json(listed, CALL_LIST), F.array().cast(CALL_LIST))


def expected_tools(truth: Column) -> Column:
    """Ordered distinct function names of an answer.

    ``truth`` is JSON text: a list of call strings, a list of objects keyed on
    the function, or a bare call string.
    """
    value = F.try_parse_json(truth)
    as_strings = F.try_variant_get(value, "$", "array<string>")
    as_objects = F.try_variant_get(value, "$", "array<map<string,variant>>")
    from_objects = F.flatten(F.transform(as_objects, lambda m: F.map_keys(m)))
    from_strings = F.transform(as_strings, call_head)
    return F.array_distinct(
        F.coalesce(from_objects, from_strings, F.array(call_head(truth)))
    )
