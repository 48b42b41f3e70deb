"""Schema-guided value extraction from query text.

Everything is an expression over the row of a query: its text, and its schema as
``array<struct<name, type, enum, item_type, default, required>>`` in required
order.  Values are strings; the type of a slot stays in its schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text as X

SCHEMA = "array<struct<name:string,type:string,enum:array<string>,item_type:string,default:string,required:boolean>>"
# Fixed value: a number in a sentence.
NUMBER = r"-?\d+\.?\d*"
NUMERIC = ("integer", "number", "float")
# Fixed value: a quoted string of either kind.
QUOTED = "['\"]([^'\"]+)['\"]"
# Fixed value: characters of a token.
TOKEN = r"a-z0-9_\-"
# Fixed value: words between what is moved and where to.
TRANSFER = r"(?i)\s(?:to|into|as)\s"

# What is looked for in a text, whatever the parameter.
PARTS = {
    "lowered": F.lower,
    "figures": lambda t: X.find_all(t, NUMBER),
    "double": X.double_quoted,
    "single": lambda t: X.find_all(t, "'([^']+)'", 1),
    "quoted": lambda t: X.find_all(t, QUOTED, 1),
    "whole": lambda t: X.find_all(t, r"\b(\d+)\b", 1),
    "numbers": X.numbers,
    "tokens": lambda t: F.split(F.lower(t), rf"[^{TOKEN}]+"),
    "halves": lambda t: F.split(t, TRANSFER, 2),
}


class Read:
    """A text and its :data:`PARTS`: expressions, or columns in which a row holds them."""

    def __init__(self, text: Column, held: Mapping[str, Column] | None = None):
        self.text, self.held = text, held or {}

    def __getattr__(self, name: str) -> Column:
        if name not in PARTS:
            raise AttributeError(name)
        return self.held[name] if name in self.held else PARTS[name](self.text)


def read(text: Column | Read) -> Read:
    return text if isinstance(text, Read) else Read(text)


def held(queries: DataFrame, text: str, *parts: str) -> tuple[DataFrame, Read]:
    """The rows with parts of their text in columns of their own, so that each is looked for once per row."""
    names = {p: f"_{text}_{p}" for p in parts}
    rows = queries.withColumns({n: PARTS[p](F.col(text)) for p, n in names.items()})
    return rows, Read(F.col(text), {p: F.col(n) for p, n in names.items()})


@dataclass(frozen=True)
class Param:
    """A parameter of a schema that is known when the job is written."""

    name: str
    type: str | None = "string"
    enum: tuple[str, ...] | None = None
    item_type: str | None = None
    default: str | None = None
    required: bool = True


def _extract(text: Column, pattern: Column | str) -> Column:
    """First group of a pattern, looked for once; null without a match."""
    found = F.call_function("regexp_extract", text, F.lit(pattern), F.lit(1))
    return X.let(found, lambda r: F.when(r != "", r))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def number_text(raw: Column, integer: Column) -> Column:
    """Text of a number: whole for an integer parameter, else with its decimals."""
    value = raw.cast("double")
    return F.when(integer, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def anchor_raw(text: Column | Read, param: Column | str) -> Column:
    """The number next to a part of the parameter's name, before or after it.

    A name given as a plain string makes the patterns literals of the plan,
    compiled once.  A part is looked for in the text first, so that a pattern is
    only built and tried where it can match.
    """
    lowered = read(text).lowered
    if isinstance(param, str):
        words = re.sub("[^a-z0-9 ]", "", param.lower().replace("_", " ")).split()
        patterns = [(w, rf"\b{w}\s*(?:of|is|=|:|\()?\s*({NUMBER})") for w in words]
        patterns += [(w, rf"({NUMBER})\s*(?:for|as|is)\s*{w}\b") for w in words]
        return F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), _extract(lowered, p)) for w, p in patterns])
    clean = F.regexp_replace(F.replace(F.lower(param), F.lit("_"), F.lit(" ")), "[^a-z0-9 ]", "")
    parts = F.filter(F.split(clean, " +"), lambda p: (p != "") & F.contains(lowered, p))

    def around(parts: Column) -> Column:
        after = F.transform(parts, lambda p: _extract(
            lowered, F.concat(F.lit(r"\b"), p, F.lit(rf"\s*(?:of|is|=|:|\()?\s*({NUMBER})"))))
        before = F.transform(parts, lambda p: _extract(
            lowered, F.concat(F.lit(rf"({NUMBER})\s*(?:for|as|is)\s*"), p, F.lit(r"\b"))))
        return F.when(F.size(parts) > 0, F.coalesce(_first(after), _first(before)))

    return X.let(parts, around)


def anchor_number(text: Column | Read, param: Column | str, integer: Column) -> Column:
    return number_text(anchor_raw(text, param), integer)


def enum_match(text: Column | Read, enum: Column) -> Column:
    """First value found in the text, else first that shares a longer word."""
    lowered = read(text).lowered
    full = F.get(F.filter(enum, lambda v: F.contains(lowered, F.lower(v))), F.lit(0))
    words = F.filter(F.split(lowered, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    partly = X.let(words, lambda ws: F.get(F.filter(
        enum, lambda v: F.exists(ws, lambda w: F.contains(F.lower(v), w) | F.contains(w, F.lower(v)))
    ), F.lit(0)))
    return F.coalesce(full, partly)


def all_numbers(text: Column | Read) -> Column:
    return read(text).figures


def positional_numbers(text: Column, missing: Column) -> Column:
    """i-th number for the i-th missing parameter: ``array<struct<param, raw>>``."""
    numbers = all_numbers(text)
    placed = F.transform(missing, lambda p, i: F.struct(p.alias("param"), F.get(numbers, i).alias("raw")))
    return F.filter(placed, lambda s: s["raw"].isNotNull())


def bool_value(text: Column | Read, param: Column | str, default: Column) -> Column:
    """``true``/``false``: said next to the name, name present, or the default.

    As in :func:`anchor_raw`, the patterns of a name given as a plain string are literals.
    """
    lowered = read(text).lowered
    said_is = r"\s*(?:is|=|:)?\s*(true|false|yes|no)\b"
    if isinstance(param, str):
        name = param.lower().replace("_", " ")
        clean = F.lit(name)
        said = F.coalesce(*[
            F.when(F.contains(lowered, F.lit(p)), _extract(lowered, rf"\b{p}{said_is}")) for p in name.split(" ")])
    else:
        clean = F.replace(F.lower(param), F.lit("_"), F.lit(" "))
        present = F.filter(F.split(clean, " "), lambda p: F.contains(lowered, p))
        said = _first(F.transform(present, lambda p: _extract(lowered, F.concat(F.lit(r"\b"), p, F.lit(said_is)))))
    explicit = F.when(said.isin("true", "yes"), "true").when(said.isNotNull(), "false")
    return F.coalesce(explicit, F.when(F.contains(lowered, clean), F.lit("true")), default)


def array_value(text: Column | Read, item_type: Column) -> Column:
    """All numbers for a numeric item type, else all double-quoted strings."""
    t = read(text)
    numbers = F.transform(t.figures, lambda n: number_text(n, item_type == "integer"))
    quoted = t.double
    numeric = item_type.isin(*NUMERIC) & (F.size(t.figures) > 0)
    return F.when(numeric, numbers).when(F.size(quoted) > 0, quoted)


def quoted_value(text: Column | Read) -> Column:
    """First double-quoted string (also an empty one), else first single-quoted."""
    t = read(text)
    return F.coalesce(F.get(t.double, F.lit(0)), F.get(t.single, F.lit(0)))


def capital_word(text: Column) -> Column:
    """First capitalised, purely alphabetic word that does not open the text."""
    words = X.split_space(text)
    return F.get(F.filter(words, lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}\p{L}+$")), F.lit(0))


def string_value(text: Column) -> Column:
    return F.coalesce(quoted_value(text), capital_word(text))


def named_value(text: Column | Read, p: Column) -> Column:
    """First pass: enum, then what the parameter's type calls for."""
    kind = F.coalesce(p["type"], F.lit("string"))
    by_type = (
        F.when(kind.isin("integer", "int"), anchor_number(text, p["name"], F.lit(True)))
        .when(kind.isin("number", "float"), anchor_number(text, p["name"], F.lit(False)))
        .when(kind == "boolean", bool_value(text, p["name"], p["default"]))
        .when(kind == "array", F.to_json(array_value(text, F.coalesce(p["item_type"], F.lit("string")))))
        .when(kind == "string", F.coalesce(quoted_value(text), anchor_raw(text, p["name"])))
    )
    return F.coalesce(F.when(p["enum"].isNotNull(), enum_match(text, p["enum"])), by_type)


def known_value(text: Column | Read, p: Param) -> Column:
    """:func:`named_value` of a known parameter: only its own branch is planned."""
    kind = p.type or "string"
    value = F.lit(None).cast("string")
    if kind in ("integer", "int", "number", "float"):
        value = anchor_number(text, p.name, F.lit(kind in ("integer", "int")))
    elif kind == "boolean":
        value = bool_value(text, p.name, F.lit(p.default).cast("string"))
    elif kind == "array":
        value = F.to_json(array_value(text, F.lit(p.item_type or "string")))
    elif kind == "string":
        value = F.coalesce(quoted_value(text), anchor_raw(text, p.name))
    if p.enum is None:
        return value
    return F.coalesce(enum_match(text, F.array(*[F.lit(e) for e in p.enum])), value)


def extract_args(queries: DataFrame, key: str, text: str, schema: str | Sequence[Param]) -> DataFrame:
    """Three passes: named or enum, numbers by position, string fallback.

    ``schema`` is the column that holds each query's own schema, or the one schema
    of all queries (its patterns are then compiled once).  Returns
    ``(key, param, value, pass)`` for every parameter that got a value.
    """
    df, t = held(queries, text, "lowered", "figures", "double", "single")
    if isinstance(schema, str):
        filled = F.transform(schema, lambda p: F.struct(
            p["name"].alias("name"), p["type"].alias("type"), p["enum"].isNotNull().alias("listed"),
            p["required"].alias("required"), named_value(t, p).alias("v")))
    else:
        filled = F.array(*[F.struct(
            F.lit(p.name).alias("name"), F.lit(p.type).cast("string").alias("type"), F.lit(p.enum is not None).alias("listed"),
            F.lit(p.required).alias("required"), known_value(t, p).alias("v")) for p in schema])
    df = df.select(key, text, all_numbers(t).alias("_numbers"), filled.alias("_n"))
    open_numeric = F.filter("_n", lambda s: s["v"].isNull() & s["required"] & s["type"].isin(*NUMERIC))

    def staged(s: Column, asked: Column) -> Column:
        place = F.array_position(asked, s["name"])
        raw = F.when(s["v"].isNull() & (place > 0), F.get("_numbers", (place - 1).cast("int")))
        return F.struct(
            s["name"].alias("param"), s["v"].alias("a"), number_text(raw, s["type"] == "integer").alias("b"),
            F.when(s["v"].isNull() & s["required"] & (F.coalesce(s["type"], F.lit("string")) == "string") & ~s["listed"],
                   capital_word(F.col(text))).alias("c"))

    asked = F.transform(open_numeric, lambda s: s["name"])
    df = df.select(key, X.let(asked, lambda o: F.transform("_n", lambda s: staged(s, o))).alias("_s"))
    # The array is never empty. A plain explode would make Spark test that with a
    # filter below, which computes all values a second time.
    rows = df.select(key, F.explode_outer("_s").alias("s")).select(key, "s.param", "s.a", "s.b", "s.c")
    stage = F.when(F.col("a").isNotNull(), "named").when(F.col("b").isNotNull(), "positional").when(F.col("c").isNotNull(), "fallback")
    return rows.select(key, "param", F.coalesce("a", "b", "c").alias("value"), stage.alias("pass")).where(F.col("value").isNotNull())


def path_tokens(text: Column) -> Column:
    """Words that look like paths: they hold a dot or a slash, closing signs and quotes aside."""
    words = F.transform(X.split_space(text), lambda w: F.regexp_replace(w, r"^['\"(]+|[\s'\").,;:!?]+$", ""))
    return F.filter(words, lambda w: F.contains(w, F.lit(".")) | F.contains(w, F.lit("/")))


# Kinds of parameter names.
FOLDER_NAMES = ("folder", "dir_name", "directory")
NAME_PARTS = ("file", "name", "source", "destination", "folder", "dir")
TEXT_PARTS = ("content", "text", "pattern", "keyword")


def param_hint(text: Column | Read, path_tokens: Column, param: Column, kind: Column) -> Column:
    """Likely value by the kind of parameter name.

    Folders take the first value without a dot, other names the first value,
    contents the longest quote, patterns the shortest, numbers the first number.
    """
    t = read(text)
    quoted = t.quoted
    values = F.concat(quoted, path_tokens)
    name = F.lower(param)

    def has(parts: Sequence[str]) -> Column:
        return name.rlike("|".join(parts))

    def by_length(sign: int) -> Column:
        # The first of several equally long quotes wins.
        ranked = F.transform(quoted, lambda q, i: F.struct((F.length(q) * sign).alias("n"), (-i).alias("i"), q.alias("q")))
        return F.array_max(ranked)["q"]

    folder = F.get(F.filter(values, lambda v: ~F.contains(v, F.lit("."))), F.lit(0))
    return (
        F.when(has(NAME_PARTS), F.when(name.isin(*FOLDER_NAMES), folder).otherwise(F.get(values, F.lit(0))))
        .when(has(TEXT_PARTS), F.when(has(("content", "text")), by_length(1)).otherwise(by_length(-1)))
        .when(kind.isin("integer", "number"), F.get(t.whole, F.lit(0)))
    )


def param_hints(queries: DataFrame, key: str, text: str, params: Sequence[Param], paths: bool = False) -> DataFrame:
    """``(key, param, hint)`` for every parameter with a likely value; ``paths``: also of paths without quotes."""
    rows, t = held(queries, text, "quoted", "whole")
    found = path_tokens(F.col(text)) if paths else F.array().cast("array<string>")
    rows = rows.withColumn("_paths", found)
    hints = F.array(*[F.struct(
        F.lit(p.name).alias("param"), param_hint(t, F.col("_paths"), F.lit(p.name), F.lit(p.type)).alias("hint")) for p in params])
    told = rows.select(key, hints.alias("_h")).select(key, F.explode_outer("_h").alias("h"))
    return told.select(key, "h.param", "h.hint").where(F.col("hint").isNotNull())


def _holds(t: Read, word: str) -> Column:
    """Is the word among the tokens?  It is looked for in the text: cutting all texts into tokens costs far more."""
    if not re.fullmatch(rf"[{TOKEN}]+", word):
        return F.array_contains(t.tokens, word)
    return F.contains(t.lowered, F.lit(word)) & F.rlike(t.lowered, F.lit(rf"(?<![{TOKEN}]){word}(?![{TOKEN}])"))


def strategy(name: str, text: Column | Read, state: Mapping[str, Column], words: Mapping[str, str]) -> Column:
    """Value of one slot strategy, or null.

    state_match:S      first value of state list S found in the text
    quoted[:n]         n-th quoted string
    quoted_filtered:S  first quoted string that is not in S
    implicit_single:S  the only value of S
    positional_before_transfer / positional_after_transfer
                       last quote before, first quote after, the first to/into/as
    number             first number
    bool_triggers      ``true`` if a trigger word is in the text
    keyword_map, fallback_words
                       value of the first listed word in the text
    """
    kind, _, argument = name.partition(":")
    t = read(text)
    quoted, lowered = t.quoted, t.lowered
    if kind == "state_match":
        return F.get(F.filter(state[argument], lambda v: F.contains(lowered, F.lower(v))), F.lit(0))
    if kind == "quoted":
        return F.get(quoted, F.lit(int(argument or 0)))
    if kind == "quoted_filtered":
        return F.get(F.filter(quoted, lambda q: ~F.array_contains(state[argument], q)), F.lit(0))
    if kind == "implicit_single":
        return F.when(F.size(state[argument]) == 1, F.get(state[argument], F.lit(0)))
    if kind == "number":
        return F.get(t.numbers, F.lit(0))
    if kind in ("positional_before_transfer", "positional_after_transfer"):
        halves = t.halves
        side = F.get(halves, F.lit(0 if "before" in kind else 1))
        found = X.find_all(side, QUOTED, 1)
        value = F.try_element_at(found, F.lit(-1)) if "before" in kind else F.get(found, F.lit(0))
        return F.when(F.size(halves) == 2, value)
    if kind == "bool_triggers":
        return F.when(reduce(or_, [_holds(t, w) for w in words], F.lit(False)), F.lit("true"))
    if kind in ("keyword_map", "fallback_words"):
        return F.coalesce(*[F.when(_holds(t, w), F.lit(v)) for w, v in words.items()])
    raise ValueError(f"unknown slot strategy {name}")


def with_slots(queries: DataFrame, text: str, slots: Mapping[str, Mapping], state: Mapping[str, Column], name: str = "filled") -> DataFrame:
    """The rows with a struct of all slots: the first strategy's value that there is, else null.

    ``slots``: slot -> ``{"strategies": [...], "words": {...}}``.
    """
    rows, t = held(queries, text, "lowered", "quoted", "numbers", "halves")
    filled = [
        F.coalesce(*[strategy(s, t, state, rule.get("words", {})) for s in rule["strategies"]]).alias(slot)
        for slot, rule in slots.items()
    ]
    return rows.select(*queries.columns, F.struct(*filled).alias(name))


def fill_slots(queries: DataFrame, key: str, text: str, slots: Mapping[str, Mapping], state: Mapping[str, Column]) -> DataFrame:
    """``(key, slot, value)`` of every slot that gets a value, see :func:`with_slots`."""
    filled = with_slots(queries, text, slots, state, "_f")
    told = F.array(*[F.struct(F.lit(s).alias("slot"), F.col("_f")[s].alias("value")) for s in slots])
    rows = filled.select(key, told.alias("_f")).select(key, F.explode_outer("_f").alias("f")).select(key, "f.slot", "f.value")
    return rows.where(F.col("value").isNotNull())


def complete(required: Column, filled: Column, slots: Iterable[str]) -> Column:
    """Has every required slot a value in the row's struct of ``slots``?"""
    known = F.size(F.array_except(required, F.array(*[F.lit(s) for s in slots]))) == 0
    return reduce(and_, [~F.array_contains(required, s) | filled[s].isNotNull() for s in slots], known)


def slots_complete(required: DataFrame, filled: DataFrame, key: str, slot: str = "slot") -> DataFrame:
    """Does every required slot of a turn have a value?"""
    joined = required.join(filled.select(key, slot, F.lit(True).alias("_has")), [key, slot], "left")
    return joined.groupBy(key).agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("complete"))


def slot_accuracy(filled: DataFrame, truth: DataFrame, key: str, func: str) -> DataFrame:
    """Calls with all, some or no correct arguments, per function.

    ``truth(key, func, param, value)``; values compare as strings.  Calls without
    arguments have no rows; calls with positional arguments (``_``) are skipped.
    """
    positional = truth.where(F.startswith("param", F.lit("_"))).select(key).distinct()
    joined = truth.join(positional, key, "left_anti").join(
        filled.select(key, "param", F.col("value").alias("_got")), [key, "param"], "left"
    )
    match = F.coalesce(F.col("_got") == F.col("value"), F.lit(False))
    return _classes(joined.groupBy(key, func).agg(F.bool_and(match).alias("all"), F.bool_or(match).alias("any")), func)


def accuracy_of_rows(calls: DataFrame, func: str, truth: Mapping[str, Column], filled: Column) -> DataFrame:
    """:func:`slot_accuracy` of calls whose true values and struct of slots stand in the row: no join.

    ``truth``: slot -> true value.
    """
    match = [F.coalesce(filled[slot] == value, F.lit(False)) for slot, value in truth.items()]
    rows = calls.select(func, *[m.alias(f"_{i}") for i, m in enumerate(match)])
    found = [F.col(f"_{i}") for i in range(len(match))]
    return _classes(rows.select(func, reduce(and_, found).alias("all"), reduce(or_, found).alias("any")), func)


def _classes(calls: DataFrame, func: str) -> DataFrame:
    return calls.groupBy(func).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("all"), 1)).alias("correct"),
        F.count(F.when(~F.col("all") & F.col("any"), 1)).alias("partial"), F.count(F.when(~F.col("any"), 1)).alias("wrong"),
    )
