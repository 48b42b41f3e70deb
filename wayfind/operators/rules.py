"""Rule lexicons: find which rules a text hits, then pick winners.

A rule table has the columns ``pattern, canonical, cls, ordinal, weight``; the
ordinal carries the list order.  ``phrase_hits`` and ``word_hits`` add an array
column ``hits``; the pickers below are expressions over that array.

A rule table of proven small size is folded into the plan as one literal, so
that matching is a projection: no join, no shuffle.  A larger one is matched by
an equi-join on an exact key (a word, or the first characters of a phrase).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators.scale import checked_literals, join_lookup, rows_if_small

INLINE_RULES = 2_000
COLUMNS = ["pattern", "canonical", "cls", "ordinal", "weight"]
RULE_TYPE = "array<struct<pattern:string,canonical:string,cls:string,ordinal:int,weight:int>>"
HIT_TYPE = (
    "array<struct<pos:int,length:int,ordinal:int,pattern:string,canonical:string,cls:string,weight:int>>"
)
GRAM = 4
INLINE_GRAMS = 20_000


def rule_table(df: DataFrame) -> DataFrame:
    """Fill in the optional columns of a rule table; a rule without a pattern hits nothing.

    A rule given twice is one rule; rules that differ in any column all count.
    """
    defaults = {"cls": F.lit(""), "weight": F.lit(1)}
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    rules = df.select("pattern", "canonical", "cls", F.col("ordinal").cast("int"), F.col("weight").cast("int"))
    return rules.where(F.length("pattern") > 0)


def _literal(rows: list[Row]) -> Column:
    ordered = sorted(dict.fromkeys(rows), key=lambda r: r["ordinal"])
    return F.from_json(F.lit(json.dumps([r.asDict() for r in ordered])), RULE_TYPE)


def _by_word(rows: list[Row]) -> Column:
    """The rules of each word, in list order, as one map."""
    found: dict[str, list[dict]] = {}
    for r in sorted(dict.fromkeys(rows), key=lambda r: r["ordinal"]):
        found.setdefault(r["pattern"], []).append(r.asDict())
    return F.from_json(F.lit(json.dumps(found)), f"map<string,{RULE_TYPE}>")


def _hit(rule: Column, pos: Column) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"),
        F.length(rule["pattern"]).alias("length"),
        rule["ordinal"].alias("ordinal"),
        rule["pattern"].alias("pattern"),
        rule["canonical"].alias("canonical"),
        rule["cls"].alias("cls"),
        rule["weight"].alias("weight"),
    )


def phrase_hits(df: DataFrame, key: str, text: Column, rules: DataFrame, name: str = "hits",
                inline: int = INLINE_RULES) -> DataFrame:
    """Add the rules whose pattern occurs anywhere in the lower-cased text."""
    rules = rule_table(rules)
    rows = rows_if_small(rules, inline)
    if rows is not None:
        # Bound once: a column of its own would be merged into the test, and the text lowered once per rule.
        found = X.let(F.lower(text), lambda low: F.filter(_literal(rows), lambda r: F.contains(low, r["pattern"])))
        return df.withColumn(name, F.transform(found, lambda r: _hit(r, F.lit(0))))
    texts = df.select(key, F.lower(text).alias("_text"))
    size = F.least(F.length("pattern"), F.lit(GRAM))
    keyed = rules.distinct().withColumn("_gram", F.substr("pattern", F.lit(1), size))
    held = checked_literals(keyed.select("_gram").distinct(), INLINE_GRAMS)
    sizes = range(1, GRAM + 1) if held is None else sorted({len(g) for g in held})
    # A look-ahead match yields every overlapping run of q characters in one pass.
    runs = [F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)) for q in sizes]
    if held is None:
        all_grams = F.concat(*[F.array_distinct(r) for r in runs])
        candidates = join_lookup(texts.select(key, F.explode(all_grams).alias("_gram")), keyed, ["_gram"])
        verified = candidates.drop("_gram").dropDuplicates([key, *COLUMNS]).join(texts, key).where(
            F.contains(F.col("_text"), F.col("pattern"))
        )
    else:
        # Texts stay where they are: only runs that open a phrase are kept, and meet their phrases there.
        opening = [F.array_distinct(F.filter(r, lambda g: g.isin(held))) for r in runs]
        none = F.array().cast("array<string>")
        given = texts.select(key, "_text", F.explode_outer(F.concat(none, *opening)).alias("_gram")).where(F.col("_gram").isNotNull())
        met = join_lookup(given, keyed, ["_gram"]).where(F.contains(F.col("_text"), F.col("pattern")))
        verified = met.select(key, *COLUMNS).dropDuplicates()
    return _attach(df, key, verified.withColumn("pos", F.lit(0)), name)


def word_hits(df: DataFrame, key: str, tokens: Column, rules: DataFrame, name: str = "hits",
              inline: int = INLINE_RULES) -> DataFrame:
    """Add the rules whose pattern equals a token, with the token's position."""
    rules = rule_table(rules)
    rows = rows_if_small(rules, inline)
    if rows is not None:
        if not rows:
            return df.withColumn(name, F.array().cast(HIT_TYPE))
        words = sorted({r["pattern"] for r in rows})
        table = _by_word(rows)
        placed = F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        known = F.filter(placed, lambda p: p["w"].isin(words))
        hits = F.flatten(
            F.transform(
                known,
                lambda p: F.transform(F.element_at(table, p["w"]), lambda r: _hit(r, p["i"])),
            )
        )
        return df.withColumn(name, hits)
    placed = df.select(key, F.posexplode(tokens).alias("pos", "pattern"))
    return _attach(df, key, join_lookup(placed, rules.distinct(), ["pattern"]), name)


def _attach(df: DataFrame, key: str, hits: DataFrame, name: str) -> DataFrame:
    """Collect the hits of each text (bounded by the text itself) onto its row."""
    gathered = hits.groupBy(key).agg(
        F.collect_list(_hit(F.struct(*COLUMNS), F.col("pos"))).alias(name)
    )
    return df.join(gathered, key, "left").withColumn(
        name, F.coalesce(F.col(name), F.array().cast(HIT_TYPE))
    )


def _pick(found: Column, default: str) -> Column:
    return F.coalesce(found["canonical"], F.lit(default))


def longest(hits: Column, default: str = "none") -> Column:
    """Canonical of the longest pattern; the earlier rule wins a tie."""
    ranked = F.transform(hits, lambda h: F.struct(h["length"], -h["ordinal"], h["canonical"].alias("canonical")))
    return _pick(F.array_max(ranked), default)


def first_listed(hits: Column, default: str = "none") -> Column:
    """Canonical of the rule that stands first in the list."""
    ranked = F.transform(hits, lambda h: F.struct(h["ordinal"], h["canonical"].alias("canonical")))
    return _pick(F.array_min(ranked), default)


def first_word(hits: Column, default: str = "none") -> Column:
    """Canonical of the leftmost word that has a rule."""
    ranked = F.transform(hits, lambda h: F.struct(h["pos"], h["ordinal"], h["canonical"].alias("canonical")))
    return _pick(F.array_min(ranked), default)


def action(phrases: Column, verbs: Column) -> Column:
    """Longest phrase, else the leading verb, else the heaviest, earliest verb."""
    leading = F.filter(verbs, lambda h: h["pos"] == 0)
    heaviest = F.array_max(
        F.transform(verbs, lambda h: F.struct(h["weight"], -h["pos"], -h["ordinal"], h["canonical"].alias("canonical")))
    )
    return (
        F.when(F.size(phrases) > 0, longest(phrases))
        .when(F.size(leading) > 0, first_word(leading))
        .otherwise(_pick(heaviest, "none"))
    )


def all_canonicals(phrases: Column, words: Column) -> Column:
    """Distinct canonicals: phrases from long to short, then single words."""
    by_length = F.array_sort(F.transform(phrases, lambda h: F.struct(-h["length"], h["ordinal"], h["canonical"].alias("c"))))
    by_rule = F.array_sort(F.transform(words, lambda h: F.struct(h["ordinal"], h["pos"], h["canonical"].alias("c"))))
    return F.array_distinct(
        F.concat(F.transform(by_length, lambda s: s["c"]), F.transform(by_rule, lambda s: s["c"]))
    )


def listed_canonicals(hits: Column) -> Column:
    """Distinct canonicals in rule order."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["ordinal"], h["canonical"].alias("c"))))
    return F.array_distinct(F.transform(ordered, lambda s: s["c"]))


def class_scores(hits: Column, classes: Sequence[str]) -> Column:
    """Score per class, in the given class order: ``(score, rank, cls)``."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(
        names,
        lambda c, i: F.struct(
            F.aggregate(
                hits, F.lit(0), lambda acc, h: acc + F.when(h["cls"] == c, h["weight"]).otherwise(0)
            ).alias("score"),
            (-i).alias("rank"),
            c.alias("cls"),
        ),
    )


def best_class(hits: Column, classes: Sequence[str]) -> Column:
    """Class with the highest score; the first class wins ties and all-zero."""
    return F.array_max(class_scores(hits, classes))["cls"]


def best_domain(hits: Column, domains: Sequence[str]) -> Column:
    """Class with the most distinct signal words; ``none`` when there are none."""
    top = F.array_max(class_scores(hits, domains))
    return F.when(top["score"] > 0, top["cls"]).otherwise("none")


def regex_labels(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of all matching patterns, distinct, in rule order.

    Every pattern is a literal of the plan, so it is compiled once.
    """
    matched = F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules])
    return F.array_distinct(F.filter(matched, lambda m: m.isNotNull()))


def leading_override(first: Column, text: Column, verbs: Sequence[str], word: str, canonical: str, otherwise: Column) -> Column:
    """A leading verb together with a word forces an action before all rules."""
    return F.when(first.isin(list(verbs)) & F.contains(F.lower(text), F.lit(word)), F.lit(canonical)).otherwise(otherwise)


def is_suppressed(action_col: Column, target_col: Column) -> Column:
    return (action_col == "none") & (target_col == "none")


def keep_available(candidates: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    return join_lookup(candidates, available, on, "left_semi")


def exclude(candidates: DataFrame, excluded: DataFrame, on: Sequence[str]) -> DataFrame:
    return join_lookup(candidates, excluded, on, "left_anti")


def apply_exclusion(candidates: DataFrame, pairs: DataFrame, query: str = "query", func: str = "func",
                    score: str = "score") -> DataFrame:
    """Of two confusable functions keep the better one.

    ``pairs(func, rival)``: a function and the rival it excludes.  When both are
    candidates of a query the one with the lower score goes; on a tie the rival.
    """
    mine = join_lookup(candidates.select(query, func, F.col(score).alias("_mine")), pairs.select(F.col("func").alias(func), "rival"), [func])
    theirs = candidates.select(query, F.col(func).alias("rival"), F.col(score).alias("_theirs"))
    both = mine.join(theirs, [query, "rival"])
    losers = both.select(
        query, F.when(F.col("_theirs") > F.col("_mine"), F.col(func)).otherwise(F.col("rival")).alias(func)
    )
    return candidates.join(losers.distinct(), [query, func], "left_anti")


def above(scores: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Strictly above: how candidates are cut."""
    return scores.where(F.col(score) > threshold)
