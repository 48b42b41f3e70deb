"""A manifest of a table as a persistent hash tree, 16 nodes to a parent.

Leaves of a group lie in order; aligned blocks of 16^3 leaves are trees of
their own, whose roots are the leaves of blocks one tier up, and so on to the
group's root; the groups' roots make the last tree.  A changed leaf makes a new
version by path copying: inside its block only the leaf's ancestors are copied
and all other nodes are shared, and above the block the version goes on as one
digest that is folded with the siblings which the unchanged upper blocks told.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import small_side, stored
from wayfind.llm.places import placed

FAN = 16
BLOCK_LEVELS = 3
SIDES = "array<struct<lefts string, rights string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class PersistentTree:
    """Versions of a tree over the same places; a version is the number of its root, and versions share nodes."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels, self.size = levels, len(leaves)
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[k:k + FAN])) for k in range(0, len(row), FAN)]
        if len(row) != 1:
            raise ValueError("too few levels for the leaves")
        self.root = row[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def path(self, place: int, root: int | None = None) -> list[tuple[int, int]]:
        """(node, which of its children) from the root down to the leaf at ``place``."""
        node, steps = self.root if root is None else root, []
        for level in range(self.levels - 1, -1, -1):
            turn = place // FAN ** level % FAN
            steps.append((node, turn))
            node = self.children[node][turn]
        return steps

    def put(self, place: int, leaf: str, root: int | None = None) -> int:
        """The root of a new version with ``leaf`` at ``place``: copies the leaf's ancestors, shares all else."""
        steps = self.path(place, root)
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for above, turn in reversed(steps):
            old = self.children[above]
            node = self._node((*old[:turn], node, *old[turn + 1:]))
        return node

    def sides(self, place: int) -> list[tuple[str, str]]:
        """Digests to the left and to the right of the path to ``place``, from the leaf's level up."""
        out = []
        for node, turn in reversed(self.path(place)):
            told = [self.digests[c] for c in self.children[node]]
            out.append(("".join(told[:turn]), "".join(told[turn + 1:])))
        return out

    def proofs(self, tail: str) -> list[str]:
        """The digest of each leaf's siblings, from its own run up to the root and on with ``tail``."""
        out, above = [], ""
        for place in range(self.size):
            first = place - place % FAN
            if place == first:  # what lies above a run of leaves is the same for all of them
                above = "".join([a + b for a, b in self.sides(place)[1:]]) + tail
            run = self.digests[first:min(first + FAN, self.size)]
            out.append(digest("".join(run[:place - first]) + "".join(run[place - first + 1:]) + above))
        return out


def fold(leaf: str, sides) -> str:
    """The root that a digest and its siblings make, level by level."""
    for lefts, rights in sides:
        leaf = digest(lefts + leaf + rights)
    return leaf


def depth(n: Column) -> Column:
    """Levels until one node remains of ``n``."""
    out = F.lit(0)
    for level in range(16):
        out = out + (n > F.lit(FAN ** level if FAN ** level < 1 << 62 else (1 << 62))).cast("int")
    return out


def _levels(done: int, block_levels: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(block_levels), F.col("depth") - done))


def climb(nodes: DataFrame, done: int, block_levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, root) of the trees over (key, place, depth, node), ``done`` levels being below, and the sides told per tier.

    A tier's table has (key, place, sides): the siblings of the node at
    ``place`` of that tier up to its block's root.  A block is one row of at
    most 16^block_levels nodes.
    """

    @F.pandas_udf(f"root string, told array<{SIDES}>")
    def blocks(nodes: pd.Series, levels: pd.Series) -> pd.DataFrame:
        out = []
        for row, n in zip(nodes, levels):
            tree = PersistentTree(list(row), int(n))
            out.append((tree.digests[tree.root], [tree.sides(k) for k in range(len(row))]))
        return pd.DataFrame(out, columns=["root", "told"])

    tiers: list[DataFrame] = []
    most = nodes.agg(F.max("depth")).first()[0] or 0
    size = FAN ** block_levels
    while done < most:
        met = nodes.groupBy("key", F.floor(F.col("place") / size).cast("bigint").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("place", "node"))).alias("m"), F.max("depth").alias("depth")
        )
        up = stored(met.withColumn("r", blocks(F.col("m.node"), _levels(done, block_levels))))
        sides = up.select("key", F.explode_outer(F.arrays_zip(F.col("m.place").alias("place"), F.col("r.told").alias("told"))).alias("x"))
        tiers.append(sides.select("key", F.col("x.place").alias("place"), F.col("x.told").alias("sides")))
        nodes = up.select("key", F.col("block").alias("place"), "depth", F.col("r.root").alias("node"))
        done += block_levels
    return nodes.select("key", F.col("node").alias("root")), tiers


def _told(rows: DataFrame, key: str, place: Column, tiers: list[DataFrame], block_levels: int) -> DataFrame:
    """``rows`` with ``sides``: the siblings above the node at ``place`` of the lowest tier, all tiers in one array."""
    rows = rows.withColumn("sides", F.array().cast(SIDES)).withColumn("_place", place)
    for tier in tiers:
        tier = tier.select(F.col("key").alias(key), F.col("place").alias("_place"), F.col("sides").alias("_more"))
        rows = rows.join(small_side(tier), [key, "_place"], "left")
        rows = rows.withColumn("sides", F.concat("sides", F.coalesce("_more", F.array().cast(SIDES)))).drop("_more")
        rows = rows.withColumn("_place", F.floor(F.col("_place") / FAN ** block_levels).cast("bigint"))
    return rows.drop("_place")


def manifest(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row of (grp string, ord, leaf, changed): ``ord, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves of a group ascend by ``ord``, then by ``leaf``; nulls come first, and
    so does the null group.  ``changed`` is the digest of the row as it is found
    now, null where it is not looked at: its version's root is ``folded_root``.
    An empty table gives no rows, equal rows a leaf each.
    """
    named = leaves.withColumn("key", F.when(F.col("grp").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("grp"))))
    rows = placed(named.select("key", "ord", "leaf", "changed"), "key", ["ord", "leaf"], "place")
    size = FAN ** block_levels
    met = rows.groupBy("key", F.floor(F.col("place") / size).cast("bigint").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "ord", F.unhex("leaf").alias("leaf"), F.unhex("changed").alias("changed")))).alias("m")
    )
    met = stored(met)
    counts = stored(met.groupBy("key").agg(F.sum(F.size("m")).alias("n")).withColumn("depth", depth(F.col("n"))))
    sized = met.join(small_side(counts), "key").withColumn("levels", _levels(0, block_levels))

    @F.pandas_udf("string")
    def block_root(nodes: pd.Series, levels: pd.Series) -> pd.Series:
        trees = [PersistentTree([bytes(x).hex() for x in row], int(n)) for row, n in zip(nodes, levels)]
        return pd.Series([t.digests[t.root] for t in trees], dtype=object)

    roots = stored(sized.select("key", F.col("block").alias("place"), "depth", block_root(F.col("m.leaf"), F.col("levels")).alias("node")))
    subroots, inner = climb(roots, block_levels, block_levels)
    # The groups' roots in order of their names are the leaves of the last tree.
    ordered = placed(subroots.select(F.lit("").alias("all"), F.col("key").alias("group"), F.col("root").alias("node")), "all", ["group"], "place")
    groups = counts.count()
    top, outer = climb(ordered.select(F.col("all").alias("key"), "place", "node", depth(F.lit(groups)).alias("depth")), 0, block_levels)
    found = top.select("root").first()
    root = F.lit(found[0] if found else None).cast("string")
    above = _told(ordered, "all", F.col("place"), outer, block_levels)
    above = above.select(F.col("group").alias("key"), F.col("node").alias("subroot"), F.col("sides").alias("outer"))
    told = _told(sized, "key", F.col("block"), inner, block_levels).join(small_side(above), "key")
    told = told.withColumn("sides", F.concat("sides", "outer")).drop("outer")

    @F.pandas_udf("array<struct<proof string, folded string>>")
    def versions(leaf: pd.Series, changed: pd.Series, levels: pd.Series, sides: pd.Series) -> pd.Series:
        out = []
        for own, other, n, upper in zip(leaf, changed, levels, sides):
            upper = [(s["lefts"], s["rights"]) for s in upper]
            tree = PersistentTree([bytes(x).hex() for x in own], int(n))
            proofs = tree.proofs("".join([a + b for a, b in upper]))
            same = fold(tree.digests[tree.root], upper)
            roots = [same if now is None else fold(tree.digests[tree.put(k, bytes(now).hex())], upper) for k, now in enumerate(other)]
            out.append(list(zip(proofs, roots)))
        return pd.Series(out, dtype=object)

    final = told.withColumn("v", versions(F.col("m.leaf"), F.col("m.changed"), F.col("levels"), F.col("sides")))
    final = final.select("subroot", F.explode_outer(F.arrays_zip(F.col("m.ord").alias("ord"), F.col("m.leaf").alias("leaf"), F.col("v").alias("v"))).alias("x"))
    return final.select(
        F.col("x.ord").alias("ord"), F.lower(F.hex("x.leaf")).alias("leaf"), "subroot", root.alias("root"),
        F.col("x.v.proof").alias("proof_sha256"), F.col("x.v.folded").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def sealed(*fields: Column) -> Column:
    """The digest of some values, each as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in fields]), 256)
