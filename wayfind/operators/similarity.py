"""Layered similarity of encoded queries and catalogs.

A bag role scores ``|A n B| / sqrt(|A| |B|)``, a categorical role 1 or 0.  Roles
average by weight inside a layer, layers average by weight overall, and both
means run over the roles present on both sides.

Pairs come from an inverted index: both sides explode to ``(role, token)`` and
join on it, so that pairs without a shared token never exist.  The token
``none`` (an empty bag) and the categorical roles would pair up everything; they
stay out of the index.  Pairs that match only in those are added from a few
representatives, which is exact for a top-k (see :func:`top_k`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators import rowscore
from wayfind.operators.features import Encoding
from wayfind.operators.scale import BROADCAST_ROWS, join_lookup, rows_if_small

DIGITS = 9


def _names(encoding: Encoding, side: str) -> list[str]:
    """Columns of a side that travel with its tokens: key, categories, bag sizes."""
    names = [f"{side}_key", *[f"{side}_{r.name}" for r in encoding.categories]]
    for r in encoding.bags:
        names += [f"{side}_{r.name}_size", f"{side}_{r.name}_none"]
    return names


def _side(df: DataFrame, key: str, encoding: Encoding, side: str) -> DataFrame:
    """One side of a comparison: the columns of :func:`_names` and the bags."""
    cols = [F.col(key).alias(f"{side}_key")]
    cols += [F.col(r.name).alias(f"{side}_{r.name}") for r in encoding.roles]
    for r in encoding.bags:
        cols.append(F.size(r.name).alias(f"{side}_{r.name}_size"))
        cols.append(F.array_contains(r.name, "none").alias(f"{side}_{r.name}_none"))
    return df.select(*cols)


def _postings(df: DataFrame, encoding: Encoding, side: str) -> DataFrame:
    """One row per indexed ``(role, token)`` of a key."""

    def indexed(number: int, bag: str) -> Column:
        items = F.coalesce(F.array_remove(bag, "none"), F.array().cast("array<string>"))
        return F.transform(items, lambda w: F.struct(F.lit(number).alias("role"), w.alias("token")))

    tokens = [indexed(i, f"{side}_{r.name}") for i, r in enumerate(encoding.bags)]
    names = _names(encoding, side)
    return df.select(*names, F.explode(F.concat(*tokens)).alias("p")).select(*names, "p.role", "p.token")


def _pairs(q: DataFrame, c: DataFrame, encoding: Encoding) -> DataFrame:
    """Both sides and the role: one row per shared token."""
    shared = join_lookup(_postings(c, encoding, "c"), _postings(q, encoding, "q"), ["role", "token"])
    return shared.select(*_names(encoding, "q"), *_names(encoding, "c"), "role")


def bag_similarity(shared: Column, size_a: Column, size_b: Column) -> Column:
    return shared / F.sqrt(size_a.cast("double") * size_b.cast("double"))


def layered(sims: dict[str, Column], encoding: Encoding) -> Column:
    """Weighted mean of layers of the weighted mean of roles; null = absent."""

    def mean(items: list[tuple[Column, float]]) -> Column:
        total = reduce(lambda a, b: a + b, [F.coalesce(s * F.lit(w), F.lit(0.0)) for s, w in items])
        weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in items])
        return F.when(weight > 0, total / weight)

    layers = []
    for layer in encoding.layers:
        roles = [r for r in encoding.roles if r.layer == layer]
        layers.append((mean([(sims[r.name], r.weight) for r in roles]), roles[0].layer_weight))
    return F.coalesce(mean(layers), F.lit(0.0))


def _scored(pairs: DataFrame, encoding: Encoding) -> DataFrame:
    """Count shared tokens per pair and role, then score the pair."""
    counts = [
        F.count(F.when(F.col("role") == i, 1)).alias(f"_n{i}") for i, _ in enumerate(encoding.bags)
    ]
    grouped = pairs.groupBy(*_names(encoding, "q"), *_names(encoding, "c")).agg(*counts)
    sims = {}
    for i, r in enumerate(encoding.bags):
        both_none = (F.col(f"q_{r.name}_none") & F.col(f"c_{r.name}_none")).cast("int")
        sims[r.name] = bag_similarity(
            F.col(f"_n{i}") + both_none, F.col(f"q_{r.name}_size"), F.col(f"c_{r.name}_size")
        )
    for r in encoding.categories:
        sims[r.name] = (F.col(f"q_{r.name}") == F.col(f"c_{r.name}")).cast("double")
    return grouped.select(
        F.col("q_key").alias("query"),
        F.col("c_key").alias("candidate"),
        F.round(layered(sims, encoding), DIGITS).alias("score"),
    )


def score_overlapping(queries: DataFrame, catalog: DataFrame, encoding: Encoding,
                      query_key: str, catalog_key: str) -> DataFrame:
    """Scores of all pairs that share at least one token."""
    q = _side(queries, query_key, encoding, "q")
    c = _side(catalog, catalog_key, encoding, "c")
    return _scored(_pairs(q, c, encoding), encoding)


def distinct_catalog(catalog: DataFrame, key: str, encoding: Encoding, k: int) -> DataFrame:
    """First ``k`` keys of every group of identically encoded rows.

    Copies score alike, so later ones cannot enter a top-k.  The rank filter is
    applied before the shuffle too, so a group of copies of any size is cheap.
    """
    roles = [r.name for r in encoding.roles]
    rank = F.row_number().over(Window.partitionBy("_signature").orderBy(key))
    signed = catalog.withColumn("_signature", F.sha2(F.to_json(F.struct(*roles)), 256))
    return signed.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank", "_signature")


def _representatives(q: DataFrame, c: DataFrame, encoding: Encoding, k: int) -> DataFrame:
    """Pairs worth scoring although they may share no indexed token.

    Without a shared token a score depends only on which categories are equal
    and which bags are empty on both sides.  For every subset of these tests a
    query needs only the first ``k`` catalog keys that pass the subset: any other
    pair has ``k`` pairs before it that score at least as much.
    """
    tests = [(r.name, False) for r in encoding.categories] + [(r.name, True) for r in encoding.bags]

    def masked(side: str) -> Column:
        """One row per subset of tests the side can pass, as a text key."""
        placed = F.array(*[
            F.struct(
                F.lit(i).alias("i"),
                (F.when(F.col(f"{side}_{name}_none"), F.lit("")) if is_bag else F.col(f"{side}_{name}")).alias("v"),
            )
            for i, (name, is_bag) in enumerate(tests)
        ])

        def used(subset: Column, p: Column) -> Column:
            return F.call_function("shiftright", subset, p["i"]).bitwiseAND(F.lit(1)) == 1

        def key(subset: Column) -> Column:
            valid = F.forall(placed, lambda p: ~used(subset, p) | p["v"].isNotNull())
            values = F.transform(placed, lambda p: F.when(used(subset, p), p["v"]))
            return F.when(valid, F.concat_ws("\x01", subset.cast("string"), values))

        subsets = F.sequence(F.lit(0), F.lit(2 ** len(tests) - 1))
        return F.explode(F.filter(F.transform(subsets, key), lambda o: o.isNotNull()))

    def first_k(df: DataFrame, by: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(by).orderBy("c_key"))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")

    constant = F.concat_ws(
        "\x01", *[F.coalesce(F.col(f"c_{n}{'_none' if bag else ''}").cast("string"), F.lit("\x02")) for n, bag in tests]
    )
    c_names, q_names = _names(encoding, "c"), _names(encoding, "q")
    few = first_k(c.select(*c_names), constant)
    candidates = first_k(few.select(*c_names, masked("c").alias("_test")), F.col("_test"))
    wanted = q.select(*q_names, masked("q").alias("_test"))
    rows = rows_if_small(candidates, BROADCAST_ROWS)
    if rows is None:
        pairs = join_lookup(wanted, candidates, ["_test"])
    else:
        # Held as rows, so that the catalog is not encoded once more for them.
        held = candidates.sparkSession.createDataFrame(rows, candidates.schema)
        pairs = wanted.join(F.broadcast(held), "_test")
    return pairs.select(*q_names, *c_names, F.lit(None).cast("int").alias("role"))


def top_k(queries: DataFrame, catalog: DataFrame, encoding: Encoding, query_key: str, catalog_key: str | list[str],
          k: int, many_copies: bool = False, max_queries: int = rowscore.MAX_QUERIES) -> DataFrame:
    """Best ``k`` of the whole catalog per query: ``(query, candidate, score, rank)``.

    Equal scores rank by catalog key.  Encoded tables must hold every role.
    Queries that are few by count are scored inside the catalog's rows (see
    :mod:`rowscore`); more of them meet the catalog in the inverted index.  Only
    the former takes several key columns, which then stand for ``candidate``.
    ``many_copies`` first reduces a catalog of few distinct encodings; for one of
    mostly distinct texts that would only shuffle the texts.
    """
    keys = [catalog_key] if isinstance(catalog_key, str) else list(catalog_key)
    side = rowscore.query_side(queries, query_key, encoding, max_queries)
    if side is not None:
        found = rowscore.raw_top_k(side, catalog, encoding, keys, k, queries.schema[query_key].dataType)
        found = found.select("query", *keys, F.round("raw", DIGITS).alias("score"))
        window = Window.partitionBy("query").orderBy(F.desc("score"), *keys)
        out = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        return out.withColumnRenamed(keys[0], "candidate") if len(keys) == 1 else out
    if len(keys) > 1:
        single = catalog.withColumn("_key", F.struct(*keys))
        out = _indexed_top_k(queries, single, encoding, query_key, "_key", k, many_copies)
        return out.select("query", "candidate.*", "score", "rank")
    return _indexed_top_k(queries, catalog, encoding, query_key, keys[0], k, many_copies)


def _indexed_top_k(queries: DataFrame, catalog: DataFrame, encoding: Encoding, query_key: str, catalog_key: str,
                   k: int, many_copies: bool) -> DataFrame:
    few = distinct_catalog(catalog, catalog_key, encoding, k) if many_copies else catalog
    q = _side(queries, query_key, encoding, "q")
    c = _side(few, catalog_key, encoding, "c")
    found = ranked(_scored(_pairs(q, c, encoding), encoding), k).drop("rank")
    # A representative that does share tokens gets its lower, token-free score
    # here. If its real score belongs to the top k it is in ``found`` as well and
    # the maximum is right; if not, k better pairs are in front of either score.
    few_more = _scored(_representatives(q, c, encoding, k), encoding)
    both = found.unionByName(few_more).groupBy("query", "candidate").agg(F.max("score").alias("score"))
    return ranked(both, k)


def pairs_above(queries: DataFrame, catalog: DataFrame, encoding: Encoding, query_key: str, catalog_key: str, threshold: float,
                max_queries: int = rowscore.MAX_QUERIES) -> DataFrame:
    """``(query, candidate, score)`` of all pairs that score ``threshold`` or more.

    Queries that are few by count are held against each row in place.  More of
    them are asked in parts, dealt by a hash of their keys, each of which reads
    the catalog once.
    """
    kind = queries.schema[query_key].dataType
    side = rowscore.query_side(queries, query_key, encoding, max_queries)
    if side is not None:
        return rowscore.pairs_above(side, catalog, encoding, catalog_key, threshold, kind)
    asked = queries.count()
    if asked <= 1:
        raise ValueError("one query holds more tokens than the index of a task may")
    parts = 2 * (asked // max_queries) + 2
    found = None
    for part in range(parts):
        few = queries.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part)
        one = pairs_above(few, catalog, encoding, query_key, catalog_key, threshold, 2 * max_queries)
        found = one if found is None else found.unionByName(one)
    return found


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Rank per query by score; with ``k`` only the first rows are shuffled."""
    window = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    out = scores.withColumn("rank", F.row_number().over(window))
    return out if k is None else out.where(F.col("rank") <= k)


def best_score(queries: DataFrame, catalog: DataFrame, encoding: Encoding, query_key: str, catalog_key: str,
               many_copies: bool = False) -> DataFrame:
    """Best score of every query over the catalog, never below 0."""
    best = top_k(queries, catalog, encoding, query_key, catalog_key, 1, many_copies)
    per_query = best.groupBy("query").agg(F.max("score").alias("best"))
    keys = queries.select(F.col(query_key).alias("query"))
    return keys.join(per_query, "query", "left").select(
        "query", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("score")
    )


RELEVANCE_THRESHOLD = 0.20
MAIN_WEIGHT, SIDECAR_WEIGHT, BLEND_THRESHOLD = 0.4, 0.6, 0.18


def relevant(scores: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """Relevant at or above the threshold."""
    return scores.withColumn("is_relevant", F.col("score") >= threshold)


def irrelevant_or_unsure(flag: Column, confidence: Column, threshold: float) -> Column:
    return flag | (confidence < threshold)


def blended(main: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Join both best scores and blend them into one decision."""
    joined = main.select("query", F.col("score").alias("main")).join(
        sidecar.select("query", F.col("score").alias("side")), "query"
    )
    blend = F.round(F.lit(MAIN_WEIGHT) * F.col("main") + F.lit(SIDECAR_WEIGHT) * F.col("side"), DIGITS)
    return joined.withColumn("blend", blend).withColumn("is_relevant", blend >= BLEND_THRESHOLD)


# Shares of the four levels in the hierarchical score.
LEVEL_WEIGHTS = {"cortex": 0.05, "layer": 0.10, "segment": 0.25, "role": 0.60}


def hierarchical(role_sims: list[Column], segment_sims: list[Column], layer_sims: list[Column], cortex: Column) -> Column:
    """Four-level score: plain means inside a level, fixed weights across."""

    def mean(items: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, items) / F.lit(float(len(items)))

    return (
        LEVEL_WEIGHTS["cortex"] * cortex
        + LEVEL_WEIGHTS["layer"] * mean(layer_sims)
        + LEVEL_WEIGHTS["segment"] * mean(segment_sims)
        + LEVEL_WEIGHTS["role"] * mean(role_sims)
    )


def shared_counts(queries: DataFrame, catalog: DataFrame, encoding: Encoding, query_key: str, catalog_key: str) -> DataFrame:
    """Number of shared tokens of every pair that has one."""
    q = _side(queries, query_key, encoding, "q")
    c = _side(catalog, catalog_key, encoding, "c")
    grouped = _pairs(q, c, encoding).groupBy("q_key", "c_key").agg(F.count(F.lit(1)).alias("shared"))
    return grouped.toDF("query", "candidate", "shared")
