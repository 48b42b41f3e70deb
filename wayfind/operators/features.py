"""Encode catalogs and queries into role features.

An encoded table has one row per key and one column per role: a string for a
categorical role, an array of distinct tokens for a bag role.  Weights and roles
are data (:class:`Encoding`), so a new domain needs rows and weights, no code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.functions import schema as S
from wayfind.functions import text as X
from wayfind.functions import words as W
from wayfind.operators import rules as R
from wayfind.operators.scale import join_lookup


@dataclass(frozen=True)
class Role:
    name: str
    weight: float
    layer: str
    layer_weight: float
    bag: bool = True


@dataclass(frozen=True)
class Encoding:
    roles: tuple[Role, ...]

    @property
    def bags(self) -> list[Role]:
        return [r for r in self.roles if r.bag]

    @property
    def categories(self) -> list[Role]:
        return [r for r in self.roles if not r.bag]

    @property
    def layers(self) -> list[str]:
        return list(dict.fromkeys(r.layer for r in self.roles))


# Layer and role weights of each encoding.
GENERIC = Encoding((
    Role("action", 1.0, "signature", 0.55, bag=False),
    Role("target", 0.7, "signature", 0.55, bag=False),
    Role("function_name", 0.9, "signature", 0.55),
    Role("description", 0.8, "semantics", 0.45),
    Role("parameters", 0.6, "semantics", 0.45),
))
PER_CLASS = Encoding((
    Role("action", 1.0, "intent", 0.55, bag=False),
    Role("target", 0.3, "intent", 0.55, bag=False),
    Role("description", 1.0, "semantics", 0.45),
    Role("parameters", 0.7, "semantics", 0.45),
))
UNIFIED = Encoding((
    Role("action", 1.0, "intent", 0.45, bag=False),
    Role("target", 0.3, "intent", 0.45, bag=False),
    Role("description", 1.0, "semantics", 0.30),
    Role("keywords", 0.5, "semantics", 0.30),
    Role("param_names", 1.0, "arguments", 0.25),
    Role("param_types", 0.3, "arguments", 0.25),
    Role("entities", 0.8, "arguments", 0.25),
))
RELEVANCE = Encoding((
    Role("param_tokens", 1.0, "param_alignment", 0.50),
    Role("name_tokens", 1.0, "name_alignment", 0.35),
    Role("desc_tokens", 1.0, "description_alignment", 0.15),
))
SIDECAR = Encoding((
    Role("name_tokens", 0.6, "all", 1.0),
    Role("target", 0.5, "all", 1.0, bag=False),
    Role("description_nouns", 0.4, "all", 1.0),
))
MEMORY = Encoding((Role("words", 1.0, "all", 1.0),))


def pattern_encoding(layers=(0.45, 0.35, 0.20), roles=None) -> Encoding:
    """Turn-pattern encoding: intent, semantics and structure layers."""
    w = {"action": 1.0, "target": 0.3, "domain": 0.5, "description": 1.0, "parameters": 0.5, "function_names": 1.0}
    w.update(roles or {})
    return Encoding((
        Role("action", w["action"], "intent", layers[0], bag=False),
        Role("target", w["target"], "intent", layers[0], bag=False),
        Role("domain", w["domain"], "intent", layers[0], bag=False),
        Role("description", w["description"], "semantics", layers[1]),
        Role("parameters", w["parameters"], "semantics", layers[1]),
        Role("function_names", w["function_names"], "structure", layers[2]),
    ))


def _or(first: Column, second: Column) -> Column:
    return X.let(first, lambda f: F.when(F.size(f) > 0, f).otherwise(second))


def encode_functions(catalog: DataFrame, key: str, verbs: DataFrame, nouns: DataFrame, head: int | None = None) -> DataFrame:
    """Catalog ``(key, name, description, props)`` -> GENERIC roles.

    In a dotted name the last part leads the action text, the class prefix stays
    out of the target text, and only the last part feeds the name bag.  ``head``
    takes only so many characters of a description for action and target.
    """
    dotted = F.contains("name", F.lit("."))
    last = X.split_name(C.bare_name(F.col("name")))
    full = X.split_name(F.col("name"))
    desc = X.clean_description(F.coalesce("description", F.lit("")))
    start = F.col("_desc") if head is None else F.substring("_desc", 1, head)
    df = (
        catalog.withColumn("_desc", desc)
        .withColumn("_last", F.when(dotted, last).otherwise(""))
        .withColumn("_full", full)
        .withColumn("_desc_words", X.intent_words(start))  # the long part, cut into words once for both
        .withColumn("_action_words", F.concat(X.intent_words(F.concat_ws(" ", "_last", "_full")), "_desc_words"))
        .withColumn("_target_words", F.concat(X.intent_words(F.concat_ws(" ", F.when(dotted, F.col("_last")).otherwise(F.col("_full")))), "_desc_words"))
    )
    df = R.word_hits(df, key, F.col("_action_words"), verbs, "_verbs")
    df = R.word_hits(df, key, F.col("_target_words"), nouns, "_nouns")
    no_phrase = F.array().cast(R.HIT_TYPE)
    return df.select(
        key,
        R.action(no_phrase, F.col("_verbs")).alias("action"),
        R.first_word(F.col("_nouns")).alias("target"),
        X.bag_items(X.tokenize(F.when(dotted, F.col("_last")).otherwise(F.col("_full")))).alias("function_name"),
        X.bag_items(X.tokenize(F.col("_desc"))).alias("description"),
        X.bag_items(S.param_tokens(F.col("props"))).alias("parameters"),
    )


def encode_queries(queries: DataFrame, key: str, text: str, verbs: DataFrame, nouns: DataFrame,
                   phrases: DataFrame) -> DataFrame:
    """Query text -> GENERIC roles.

    The name bag holds all tokens plus the canonical action of every matching
    phrase; the description bag drops framing words.
    """
    df = queries.withColumn("_words", X.intent_words(F.col(text)))
    df = R.word_hits(df, key, F.col("_words"), verbs, "_verbs")
    df = R.word_hits(df, key, F.col("_words"), nouns, "_nouns")
    df = R.phrase_hits(df, key, F.col(text), phrases, "_phrases")
    tokens = X.tokenize(F.col(text))
    none = F.array().cast(R.HIT_TYPE)
    return df.select(
        key,
        R.action(F.col("_phrases"), F.col("_verbs")).alias("action"),
        R.first_word(F.col("_nouns")).alias("target"),
        X.bag_items(F.concat(tokens, R.all_canonicals(F.col("_phrases"), none))).alias("function_name"),
        X.bag_items(X.what_tokens(tokens)).alias("description"),
        X.bag_items(_or(X.query_params(F.col(text)), tokens)).alias("parameters"),
    )


def encode_class_functions(catalog: DataFrame, key: str, intents: DataFrame, target_defaults: DataFrame) -> DataFrame:
    """Catalog ``(key, cls, name, description, props)`` -> PER_CLASS roles.

    ``intents(cls, func, action, target)`` maps the bare function name; the
    default target of a class comes from ``target_defaults(cls, default_target)``.
    One operator serves every class: the classes differ in rows only.
    """
    df = catalog.withColumn("func", C.bare_name(F.col("name")))
    df = join_lookup(df, intents, ["cls", "func"], "left")
    df = join_lookup(df, target_defaults, ["cls"], "left")
    df = df.withColumn("_desc", X.tokenize(X.clean_description(F.coalesce("description", F.lit("")))))
    desc = F.col("_desc")
    name = X.tokenize(X.split_name(F.col("func")))
    params = S.param_tokens(F.col("props"), with_type=False)
    return df.select(
        key, "cls",
        F.coalesce("action", F.lit("none")).alias("action"),
        F.coalesce("target", "default_target", F.lit("none")).alias("target"),
        X.bag_items(F.concat(desc, name)).alias("description"),
        X.bag_items(_or(params, desc)).alias("parameters"),
    )


def encode_pattern_queries(queries: DataFrame, text: str) -> DataFrame:
    """Queries with action, target and domain columns -> turn-pattern roles."""
    tokens = X.pattern_tokens(F.col(text))
    return queries.select(
        *[c for c in queries.columns if c != text],
        X.bag_items(X.what_tokens(tokens)).alias("description"),
        X.bag_items(X.pattern_params(F.col(text))).alias("parameters"),
        F.array(F.lit("none")).alias("function_names"),
    )


def encode_exemplars(exemplars: DataFrame, key: str, with_domain: bool = False) -> DataFrame:
    """Exemplar records -> role features; a missing field counts as ``none``."""

    def bag_of(col: str) -> Column:
        return X.bag_items(X.split_space(F.coalesce(F.col(col), F.lit("none"))))

    names = ["action", "target", *(["domain"] if with_domain else [])]
    return exemplars.select(
        key,
        *[F.coalesce(F.col(c), F.lit("none")).alias(c) for c in names],
        bag_of("function_name_bow").alias("function_names" if with_domain else "function_name"),
        bag_of("description").alias("description"),
        bag_of("parameters_bow").alias("parameters"),
    )


def encode_unified(catalog: DataFrame, key: str, targets: tuple[str, ...], words: int | None = None) -> DataFrame:
    """Catalog -> UNIFIED roles; the bare name is the action.

    The target is the first listed noun found in the description or the name.
    ``words`` takes only so many description words as keywords.
    """
    bare = C.bare_name(F.col("name"))
    desc = X.clean_description(F.coalesce("description", F.lit("")), last_marker=True)
    df = catalog.withColumn("_bare", bare).withColumn("_desc", desc)
    nouns = F.array(*[F.lit(n) for n in targets])
    found = F.filter(nouns, lambda n: F.contains(F.lower("_desc"), n) | F.contains(F.lower("_bare"), n))
    name_words = X.split_space(X.split_name(F.col("_bare")))
    tokens = X.tokenize(F.col("_desc"))
    props = F.col("props")
    return df.select(
        key,
        F.col("_bare").alias("action"),
        F.coalesce(F.get(found, F.lit(0)), F.lit("none")).alias("target"),
        X.bag_items(F.concat(tokens, name_words)).alias("description"),
        X.bag_items(F.concat(X.tokenize(X.split_name(F.col("_bare"))), X.leading(tokens, words))).alias("keywords"),
        X.bag_items(F.flatten(F.transform(F.map_keys(props), lambda k: X.split_space(X.split_name(k))))).alias("param_names"),
        X.bag_items(S.param_types(props)).alias("param_types"),
        X.bag_items(S.param_entities(props)).alias("entities"),
    )


def encode_relevance_functions(catalog: DataFrame, key: str, words: int | None = None) -> DataFrame:
    """Catalog -> RELEVANCE roles, of (the first ``words``) description words."""
    return catalog.select(
        key,
        X.bag_items(S.param_names(F.col("props"))).alias("param_tokens"),
        X.bag_items(X.generic_tokens(X.split_name(F.col("name")))).alias("name_tokens"),
        X.bag_items(X.leading(X.generic_tokens(F.col("description")), words)).alias("desc_tokens"),
    )


def encode_relevance_queries(queries: DataFrame, key: str, text: str) -> DataFrame:
    bag = X.bag_items(X.generic_tokens(F.col(text)))
    return queries.select(key, bag.alias("param_tokens"), bag.alias("name_tokens"), bag.alias("desc_tokens"))


def encode_sidecar(rows: DataFrame, key: str, name: Column, description: Column, target: Column) -> DataFrame:
    """Names or queries -> SIDECAR roles."""
    return rows.select(
        key,
        X.bag_items(X.tokenize(name)).alias("name_tokens"),
        target.alias("target"),
        X.bag_items(X.noun_tokens(description)).alias("description_nouns"),
    )


def bag_columns(df: DataFrame, encoding: Encoding) -> DataFrame:
    """Encoded table with its bags as strings (for storage as JSON and reports)."""
    for role in encoding.bags:
        df = df.withColumn(role.name, F.array_join(role.name, " "))
    return df


def long_features(df: DataFrame, key: str, encoding: Encoding) -> DataFrame:
    """One row per ``(key, role, token)``."""
    arrays = [
        F.struct(F.lit(r.name).alias("role"), (F.col(r.name) if r.bag else F.array(r.name)).alias("tokens"))
        for r in encoding.roles
    ]
    roles = df.select(key, F.explode(F.array(*arrays)).alias("r"))
    return roles.select(key, "r.role", F.explode("r.tokens").alias("token"))
