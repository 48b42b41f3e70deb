"""Column -> Column text functions.

Everything here is a native column expression: no Python runs per row, and the
functions can sit in any projection, filter or join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.functions import words as W

# Characters that split words: ASCII white space plus the Unicode separators.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def split_space(col: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(col, rf"[{SPACE}]+"), lambda w: w != "")


def split_name(col: Column) -> Column:
    """``getUserName``, ``get_user.name`` -> ``get user name``."""
    spaced = F.regexp_replace(col, r"[_\-.]", " ")
    return strip(F.lower(F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")))


def without(tokens: Column, stop: Sequence[str], min_length: int = 2) -> Column:
    """Drop stop words and words shorter than ``min_length``."""
    return F.filter(tokens, lambda w: (F.length(w) >= min_length) & ~w.isin(list(stop)))


def tokenize(col: Column, stop: Sequence[str] = W.STOP_WORDS, keep: str = "a-z0-9") -> Column:
    """Lower-case words; characters outside ``keep`` are deleted, not spaced."""
    cleaned = F.regexp_replace(F.lower(col), rf"[^{keep}{SPACE}]", "")
    return without(F.split(cleaned, rf"[{SPACE}]+"), stop)


def tokenize_spaced(col: Column) -> Column:
    """Lower-case words; every other character separates words."""
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def intent_words(col: Column) -> Column:
    """Alphabetic words of a name or sentence, for the verb and noun lexicons."""
    return F.filter(F.split(split_name(col), "[^a-z]+"), lambda w: w != "")


def generic_tokens(col: Column) -> Column:
    return tokenize(col, W.STOP_WORDS + W.GENERIC_WORDS)


def noun_tokens(col: Column) -> Column:
    return tokenize(col, W.STOP_WORDS + W.FILLER_WORDS)


def memory_tokens(col: Column) -> Column:
    return tokenize(col, W.MEMORY_STOP_WORDS, keep=r"a-z0-9@_.'\-")


def pattern_tokens(col: Column) -> Column:
    return tokenize(col, W.STOP_WORDS + W.PATTERN_EXTRA_STOP_WORDS)


def keywords(col: Column) -> Column:
    """Space-joined content words of a sentence or name."""
    spaced = F.split(split_name(col), "[^a-z0-9]+")
    return F.array_join(without(spaced, W.STOP_WORDS + W.KEYWORD_EXTRA_STOP_WORDS), " ")


def clean_query(col: Column) -> Column:
    """Keyword form of a task query; ``_`` counts as a letter."""
    spaced = F.split(F.lower(col), "[^a-z0-9_]+")
    return F.array_join(without(spaced, W.TASK_STOP_WORDS), " ")


def bag(tokens: Column) -> Column:
    """Distinct tokens in first-seen order, joined; ``none`` for an empty bag."""
    joined = F.array_join(F.array_distinct(tokens), " ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def bag_items(tokens: Column) -> Column:
    """The bag as an array: distinct tokens, or the single token ``none``."""
    return let(F.array_distinct(tokens), lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(F.lit("none"))))


def what_tokens(tokens: Column) -> Column:
    """Tokens without framing words; all tokens if nothing else is left."""

    def chosen(all_tokens: Column) -> Column:
        what = F.filter(all_tokens, lambda w: ~w.isin(list(W.HOW_WORDS)))
        return F.when(F.size(what) > 0, what).otherwise(all_tokens)

    return let(tokens, chosen)


def clean_description(col: Column, last_marker: bool = False) -> Column:
    """Text after the boilerplate marker, without its filler opening.

    ``last_marker`` cuts at the last marker instead of the first.
    """
    lead = ".*" if last_marker else ".*?"
    cut = F.regexp_replace(col, rf"(?is)^{lead}{W.DESCRIPTION_MARKER}[{SPACE}]*", "")
    text = F.when(F.contains(col, F.lit(W.DESCRIPTION_MARKER)), cut).otherwise(col)
    return strip(F.regexp_replace(text, rf"(?i)^{W.FILLER_OPENING}[,{SPACE}]*", ""))


def leading(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all without ``n``."""
    return items if n is None else F.slice(items, 1, n)


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def double_quoted(col: Column) -> Column:
    return find_all(col, '"([^"]*)"', 1)


def single_quoted(col: Column) -> Column:
    return find_all(col, "'([^']*)'", 1)


def numbers(col: Column) -> Column:
    return find_all(col, r"\b\d+\.?\d*\b")


def query_params(col: Column) -> Column:
    """Quoted strings, then numbers, then tokens; distinct in that order."""
    return F.array_distinct(
        F.concat(double_quoted(col), single_quoted(col), numbers(col), tokenize(col))
    )


def pattern_params(col: Column) -> Column:
    """Tokens first, then quoted strings and numbers (turn patterns)."""
    return F.array_distinct(
        F.concat(pattern_tokens(col), double_quoted(col), single_quoted(col), numbers(col))
    )


def entities(col: Column) -> Column:
    """Quoted strings, file names, numbers and @mentions, distinct in order."""
    return F.array_distinct(
        F.concat(
            single_quoted(col),
            double_quoted(col),
            find_all(col, r"\b[\w-]+\.[\w]+\b"),
            numbers(col),
            find_all(col, r"@(\w+)", 1),
        )
    )


# Clause boundaries of passage retrieval.
SENTENCE_BREAK = rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])|\n[{SPACE}]*\n"
CLAUSE_BREAK = (
    rf"[;—–][{SPACE}]*|,[{SPACE}]+(?:and|but|so|or|because|which|where|who|although)[{SPACE}]+"
)


def clauses(col: Column, min_length: int = 6) -> Column:
    """Ordered clauses of a text; pieces under ``min_length`` are dropped."""
    sentences = F.transform(F.split(col, SENTENCE_BREAK), strip)
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, CLAUSE_BREAK)))
    return F.filter(F.transform(parts, strip), lambda c: F.length(c) >= min_length)


def comparable(col: Column) -> Column:
    """Lower-case, punctuation removed (ASCII word characters stay), trimmed."""
    return strip(F.regexp_replace(F.lower(col), rf"[^a-z0-9_{SPACE}]", ""))
