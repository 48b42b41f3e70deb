"""Ordered conversation state as batch jobs.

The order of a conversation is the only sequential dependency.  Everything that
can be said with counts, first positions or running sums is; the path fold works
in blocks of calls, so that no conversation has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.functions import calls as C
from wayfind.functions import text as X
from wayfind.operators.scale import Ordered, join_lookup

BLOCK = 64

STATE = "struct<pops:int,path:array<string>>"


def _combine(a: Column, b: Column) -> Column:
    """Effect of two path changes in a row: levels left, then levels entered."""
    depth = F.size(a["path"])
    inside = b["pops"] <= depth
    return F.struct(
        F.when(inside, a["pops"]).otherwise(a["pops"] + b["pops"] - depth).cast("int").alias("pops"),
        F.when(inside, F.concat(F.slice(a["path"], F.lit(1), F.greatest(depth - b["pops"], F.lit(0))), b["path"]))
        .otherwise(b["path"]).alias("path"),
    )


def _empty_state() -> Column:
    return F.struct(F.lit(0).cast("int").alias("pops"), F.array().cast("array<string>").alias("path"))


def _scan(items: DataFrame, key: str, longest: int) -> DataFrame:
    """Running combination of ``state`` in the order of the dense ``pos``.

    Blocks of ``BLOCK`` rows are folded on their own; the block totals are
    scanned the same way, one level up, and put in front of their blocks.
    """
    blocks = items.groupBy(key, F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "state"))).alias("rows")
    )
    folded = blocks.withColumn(
        "states",
        F.aggregate(
            "rows",
            F.array().cast(f"array<struct<pos:bigint,state:{STATE}>>"),
            lambda acc, row: F.concat(
                acc,
                F.array(F.struct(
                    row["pos"].cast("bigint").alias("pos"),
                    _combine(F.coalesce(F.try_element_at(acc, F.lit(-1))["state"], _empty_state()), row["state"]).alias("state"),
                )),
            ),
        ),
    ).drop("rows")
    if longest < BLOCK:
        return folded.select(key, F.explode("states").alias("s")).select(key, "s.pos", "s.state")
    folded = checkpointed(folded)
    totals = folded.select(key, F.col("block").alias("pos"), F.element_at("states", -1)["state"].alias("state"))
    above = _scan(totals, key, longest // BLOCK)
    before = above.select(key, (F.col("pos") + 1).alias("block"), F.col("state").alias("before"))
    joined = folded.join(before, [key, "block"], "left").withColumn("before", F.coalesce("before", _empty_state()))
    rows = joined.select(key, "before", F.explode("states").alias("s"))
    return rows.select(key, "s.pos", _combine(F.col("before"), F.col("s.state")).alias("state"))


def working_path(calls: DataFrame, key: str, position: str, folder: Column) -> DataFrame:
    """Path after every call: ``..`` leaves a level (nothing at the root), ``.``
    and an empty or missing folder change nothing, anything else enters it.

    ``position`` counts the calls of a conversation from 1.
    """
    change = F.when(folder == "..", F.struct(F.lit(1).cast("int").alias("pops"), F.array().cast("array<string>").alias("path"))).when(
        folder.isNull() | folder.isin("", "."), _empty_state()
    ).otherwise(F.struct(F.lit(0).cast("int").alias("pops"), F.array(folder).alias("path")))
    items = calls.select(key, (F.col(position) - 1).cast("bigint").alias("pos"), change.alias("state"))
    longest = items.agg(F.max("pos")).first()[0] or 0
    scanned = _scan(items, key, longest)
    return scanned.select(key, (F.col("pos") + 1).alias(position), F.col("state.path").alias("path"))


def first_calls(calls: DataFrame, key: str, func: str, position: str) -> DataFrame:
    """First position of every function of a conversation."""
    return calls.groupBy(key, func).agg(F.min(position).alias("first"))


def called_before(calls: DataFrame, key: str, func: str, position: str) -> DataFrame:
    """Sorted functions called before each position.

    A function is in the set once its first call lies behind; the first calls
    (one per catalog function) are joined back instead of growing a set per row.
    """
    firsts = first_calls(calls, key, func, position).groupBy(key).agg(
        F.collect_list(F.struct(F.col(func).alias("func"), "first")).alias("_firsts")
    )
    joined = join_lookup(calls, firsts, [key])
    seen = F.filter("_firsts", lambda f: f["first"] < F.col(position))
    return joined.withColumn("called", F.array_sort(F.transform(seen, lambda f: f["func"]))).drop("_firsts")


def history(utterances: DataFrame, key: str, position: str, value: Column, block: int = BLOCK) -> DataFrame:
    """What was said before each turn of a conversation, in ``recent``, whatever its length.

    The turn's own block of ``block`` turns is a window.  Each block has one row
    with all that was said before it, which its turns join on conversation and
    block, so that a long conversation is spread over tasks.  Positions count
    from 1, without gaps.
    """
    placed = utterances.withColumn("_block", F.floor((F.col(position) - 1) / block).cast("bigint"))
    before = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_own", F.collect_list(value).over(before))
    last = utterances.agg(F.max(position)).first()[0] or 0
    if last <= block:
        return placed.withColumnRenamed("_own", "recent").drop("_block")
    chain = prefix_chain(history_blocks(utterances, key, position, value, block), key, -(-last // block))
    chain = chain.select(key, F.col("block").alias("_block"), F.col("before").alias("_before"))
    joined = placed.join(chain, [key, "_block"], "left")
    earlier = F.coalesce("_before", F.array().cast(placed.schema["_own"].dataType))
    return joined.withColumn("recent", F.concat(earlier, "_own")).drop("_block", "_own", "_before")


def prefix_chain(blocks: DataFrame, key: str, longest: int) -> DataFrame:
    """``(key, block, before)``: the values of all earlier blocks, for the blocks numbered 0 to ``longest`` - 1.

    Every round puts in front of a block's values those that end where they
    begin, so the reach doubles; all rounds join on key and block.
    """
    chain = blocks.select(key, (F.col("block") + 1).alias("block"), F.col("values").alias("before"))
    reach = 1
    while reach < longest:
        chain = checkpointed(chain)
        earlier = chain.select(key, (F.col("block") + reach).alias("block"), F.col("before").alias("_earlier"))
        chain = chain.join(earlier, [key, "block"], "left")
        front = F.coalesce("_earlier", F.slice("before", 1, 0))
        chain = chain.select(key, "block", F.concat(front, "before").alias("before"))
        reach *= 2
    return chain


def history_blocks(utterances: DataFrame, key: str, position: str, value: Column, block: int = BLOCK) -> DataFrame:
    number = F.floor((F.col(position) - 1) / block).cast("bigint").alias("block")
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v"))))
    said = F.filter(F.transform(rows, lambda r: r["v"]), lambda v: v.isNotNull())
    return utterances.groupBy(key, number).agg(said.alias("values"))


def holdout(turns: DataFrame, added: DataFrame, key: str, position: str, query: str, split_on: Column,
            opening: str = "Added functions: {}", replay: str = "; open request: {}", nothing: str = "; no open request") -> DataFrame:
    """Turns at which held-out functions come back, and the turn before each.

    ``added(key, position, names)``: the functions that return at a turn.  Such a
    turn replays the query before it; the turn in front of it is a hold-out turn.
    The text is ``opening`` with the names, then ``replay`` with that query, or
    ``nothing`` if there is none.
    """
    joined = turns.join(added, [key, position], "left")
    ordered = Ordered(joined, [key], [position], split_on)
    ordered = ordered.previous("_prev", F.col(query)).following("_next", F.col("names").isNotNull())
    df = ordered.result()
    told = lambda text, col: F.replace(F.lit(text), F.lit("{}"), F.col(col))
    asked = F.length(F.coalesce("_prev", F.lit(""))) > 0
    full = F.concat(told(opening, "names"), F.when(asked, told(replay, "_prev")).otherwise(F.lit(nothing)))
    return df.withColumn("text", F.when(F.col("names").isNotNull(), full).otherwise(F.col(query))).withColumn(
        "is_holdout", F.coalesce("_next", F.lit(False))
    ).drop("_prev", "_next")


def visible_functions(turns: DataFrame, functions: DataFrame, key: str, position: str) -> DataFrame:
    """Number of visible functions per turn: always there, or back by then.

    ``functions(key, func, from_turn)``: 0 for one that is there from the start.
    The functions of a conversation are few (a catalog); they are packed per
    conversation and compared with the turn in the row.
    """
    packed = functions.groupBy(key).agg(F.collect_list(F.struct("func", "from_turn")).alias("_funcs"))
    joined = join_lookup(turns, packed, [key], "left")
    seen = F.filter("_funcs", lambda f: f["from_turn"] <= F.col(position))
    names = F.array_sort(F.transform(F.coalesce(seen, F.array().cast("array<struct<func:string,from_turn:int>>")), lambda f: f["func"]))
    return joined.withColumn("visible", names).drop("_funcs")


def inject_prerequisites(turns: DataFrame, rules: DataFrame, key: str, position: str, func: str,
                         firsts: DataFrame, available: DataFrame) -> DataFrame:
    """Prerequisites to put in front of each turn's calls.

    ``rules(func, prereq, one_shot)``.  A prerequisite is added if it is available
    to the conversation, is not among the turn's calls, and, for a one-shot rule,
    was not called in an earlier turn (``firsts(key, func, first)``).
    """
    calls = turns.select(key, position, func).distinct()
    wanted = join_lookup(calls, rules.select(F.col("func").alias(func), "prereq", "one_shot"), [func]).select(
        key, position, "prereq", "one_shot"
    ).distinct()
    usable = wanted.join(available.select(key, F.col(func).alias("prereq")).distinct(), [key, "prereq"], "left_semi")
    absent = usable.join(calls.select(key, position, F.col(func).alias("prereq")), [key, position, "prereq"], "left_anti")
    seen = firsts.select(key, F.col(func).alias("prereq"), "first")
    joined = absent.join(seen, [key, "prereq"], "left")
    done = F.col("one_shot") & F.coalesce(F.col("first") < F.col(position), F.lit(False))
    return joined.where(~done).select(key, position, "prereq").distinct()


def transitions(calls: DataFrame, key: str, order: Sequence[str], split_on: Column, action: str,
                directing: Sequence[str], operating: Sequence[str]) -> DataFrame:
    """Flag an operating action right after a directing one: the place changed."""
    df = Ordered(calls, [key], order, split_on).previous("_prev", F.col(action)).result()
    needs = F.coalesce(F.col("_prev").isin(list(directing)), F.lit(False)) & F.col(action).isin(list(operating))
    return df.withColumn("needs_switch", needs).drop("_prev")


def path_steps(start: Column, goal: Column) -> Column:
    """Folder steps from one path to another: up to the shared prefix, then down."""
    shared = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(F.size(start), F.size(goal)) - 1, F.lit(0))),
        F.lit(0),
        lambda n, i: F.when((n == i) & (F.get(start, i) == F.get(goal, i)), n + 1).otherwise(n),
    )
    up = F.array_repeat(F.lit(".."), F.size(start) - shared)
    down = F.slice(goal, shared + 1, F.greatest(F.size(goal) - shared, F.lit(0)))
    return F.concat(up, down)


def mentions(text: Column, files: Column, dirs: Column) -> tuple[Column, Column]:
    """Files and directories a text mentions, quoted or bare.

    Quoted known names first, then bare known names in tree order; an unknown
    quoted name is a file if it holds a dot, else a directory.
    """
    quoted = F.array_distinct(F.concat(X.single_quoted(text), X.double_quoted(text)))

    def known(names: Column) -> Column:
        return F.array_union(F.array_intersect(quoted, names), F.filter(names, lambda n: F.contains(text, n)))

    new = F.filter(quoted, lambda q: ~F.array_contains(files, q) & ~F.array_contains(dirs, q))
    return (
        F.array_union(known(files), F.filter(new, lambda q: F.contains(q, F.lit(".")))),
        F.array_union(known(dirs), F.filter(new, lambda q: ~F.contains(q, F.lit(".")))),
    )


def turn_context(path: Column, files: Column, dirs: Column, scores: Column, pattern: Column, pattern_score: Column,
                 threshold: float = 0.45, names: int | None = None) -> Column:
    """Context lines of a turn: path, names, top scores, and the pattern with its score.

    ``scores``: ranked ``array<struct<name, score>>``; only the five best above
    0.10 are shown.  The pattern is shown if its score reaches ``threshold``.
    ``names`` shortens the lists of files and folders; all are shown without it.
    """
    shown = F.filter(F.slice(scores, 1, 5), lambda s: s["score"] > 0.10)
    parts = F.transform(shown, lambda s: F.concat(C.bare_name(s["name"]), F.lit(" ("), F.format_number(s["score"], 2), F.lit(")")))

    def line(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("CWD: /"), F.array_join(path, "/")),
        line("Files: ", files if names is None else F.slice(files, 1, names)),
        line("Dirs: ", dirs if names is None else F.slice(dirs, 1, names)),
        line("Routing: ", parts),
        F.when(pattern_score >= threshold, F.concat(
            F.lit("Pattern: "), F.replace(pattern, F.lit("|"), F.lit(" → ")), F.lit(" ("), F.format_number(pattern_score, 2), F.lit(")"))),
    )


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Path of every node of a parent table ``(node, parent, name, kind)``.

    One join per level, until a level is empty; the root nodes have no parent.
    A node that is its own ancestor is an error.
    """
    level = nodes.where(F.col("parent").isNull()).select("node", "kind", F.array("name").alias("path"), F.array("node").alias("_above"))
    found = level.drop("_above")
    while True:
        below = nodes.select("node", F.col("parent"), "name", "kind").join(
            level.select(F.col("node").alias("parent"), "path", "_above"), "parent"
        )
        again = F.array_contains("_above", F.col("node"))
        level = checkpointed(below.select(
            "node", "kind", F.concat("path", F.array("name")).alias("path"), F.concat("_above", F.array("node")).alias("_above"), again.alias("_again")
        ))
        if not level.where("_again").isEmpty():
            raise ValueError("the tree has a cycle")
        level = level.drop("_again")
        if level.isEmpty():
            return found
        found = found.unionByName(level.drop("_above"))


def tree_contents(paths: DataFrame) -> DataFrame:
    """Number of files and folders per directory path.

    The names stay in long form (:func:`flatten_tree`): a directory may hold any
    number of them.
    """
    parent = F.array_join(F.slice("path", 1, F.size("path") - 1), "/").alias("path")
    child = paths.where(F.size("path") > 1).select(parent, "kind")
    return child.groupBy("path").agg(
        F.count(F.when(F.col("kind") == "file", 1)).alias("n_files"),
        F.count(F.when(F.col("kind") == "directory", 1)).alias("n_dirs"),
    )
