"""SQL fragments for the reference SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from wayfind.functions import words as W

SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def words_list(words: Sequence[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def split_name(col: str) -> str:
    return strip(
        f"lower(regexp_replace(regexp_replace({col}, '[_\\-.]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'))"
    )


def nonempty(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: w <> '')"


def without(tokens: str, stop: Sequence[str], extra: str = "") -> str:
    return f"list_filter({tokens}, lambda w: length(w) > 1 and not list_contains({words_list(stop)}, w){extra})"


def tokenize(col: str, stop: Sequence[str] = W.STOP_WORDS, keep: str = "a-z0-9") -> str:
    cleaned = f"regexp_replace(lower({col}), '[^{keep}{SPACE}]', '', 'g')"
    return without(f"string_split_regex({cleaned}, '[{SPACE}]+')", stop)


def tokenize_spaced(col: str) -> str:
    return nonempty(f"string_split_regex(lower({col}), '[^a-z0-9]+')")


def intent_words(col: str) -> str:
    return nonempty(f"string_split_regex({split_name(col)}, '[^a-z]+')")


def distinct(tokens: str) -> str:
    """First-seen order kept."""
    return f"list_filter({tokens}, lambda w, i: list_position({tokens}, w) = i)"


def bag(tokens: str) -> str:
    return f"coalesce(nullif(array_to_string({distinct(tokens)}, ' '), ''), 'none')"


def joined(tokens: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({tokens}, '{sep}'), '')"


def bag_items(tokens: str) -> str:
    return f"CASE WHEN len(list_distinct({tokens})) > 0 THEN list_distinct({tokens}) ELSE ['none'] END"


def placed(tokens: str) -> str:
    return f"(SELECT unnest({tokens}) AS w, generate_subscripts({tokens}, 1) AS i)"


def first_word(tokens: str, rules: str) -> str:
    return (
        f"coalesce((SELECT r.canonical FROM {placed(tokens)} x JOIN {rules} r ON r.pattern = x.w ORDER BY i LIMIT 1), 'none')"
    )


def action(tokens: str, verbs: str, phrase: str = "NULL") -> str:
    return (
        f"coalesce({phrase}, (SELECT r.canonical FROM {placed(tokens)} x JOIN {verbs} r ON r.pattern = x.w WHERE i = 1), "
        f"(SELECT r.canonical FROM {placed(tokens)} x JOIN {verbs} r ON r.pattern = x.w ORDER BY r.weight DESC, i LIMIT 1), 'none')"
    )


def clean_description(col: str) -> str:
    cut = f"CASE WHEN contains({col}, '{W.DESCRIPTION_MARKER}') THEN regexp_replace({col}, '^.*?{W.DESCRIPTION_MARKER}[{SPACE}]*', '', 'is') ELSE {col} END"
    return strip(f"regexp_replace({cut}, '^{W.FILLER_OPENING}[,{SPACE}]*', '', 'i')")


def double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def all_scores(encoding, q: str = "q", c: str = "c", out: str = "scores") -> str:
    """CTEs ending in ``out(query, candidate, score)`` for every pair of two encoded CTEs."""
    parts, sims, joins = [], {}, ""
    for r in encoding.roles:
        if r.bag:
            parts.append(
                f"sh_{r.name} AS (SELECT a.key AS qk, b.key AS ck, count(*) AS n FROM (SELECT key, unnest({r.name}) AS w FROM {q}) a "
                f"JOIN (SELECT key, unnest({r.name}) AS w FROM {c}) b USING (w) GROUP BY ALL)"
            )
            joins += f" LEFT JOIN sh_{r.name} ON sh_{r.name}.qk = {q}.key AND sh_{r.name}.ck = {c}.key"
            sims[r.name] = (
                f"(coalesce(sh_{r.name}.n, 0) / sqrt(CAST(len({q}.{r.name}) AS DOUBLE) * CAST(len({c}.{r.name}) AS DOUBLE)))"
            )
        else:
            sims[r.name] = f"(CASE WHEN {q}.{r.name} = {c}.{r.name} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"

    def mean(items):
        total = " + ".join(f"{s} * {double(w)}" for s, w in items)
        weight = " + ".join(double(w) for _, w in items)
        return f"(({total}) / ({weight}))"

    layers = []
    for layer in encoding.layers:
        roles = [r for r in encoding.roles if r.layer == layer]
        layers.append((mean([(sims[r.name], r.weight) for r in roles]), roles[0].layer_weight))
    parts.append(
        f"{out} AS (SELECT {q}.key AS query, {c}.key AS candidate, round({mean(layers)}, 9) AS score FROM {q} CROSS JOIN {c}{joins})"
    )
    return ",\n".join(parts)


def top_k(k: int, scores: str = "scores") -> str:
    return (
        f"SELECT query, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank "
        f"FROM {scores}) WHERE rank <= {k}"
    )
