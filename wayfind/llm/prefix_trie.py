"""The trie of conversations: one node per distinct beginning, with its members, leaves and savings.

Conversations become words over turn digests.  Distinct words are sorted into
range shards; each shard codes its turns in a dictionary and inserts its words
median first into a ternary search tree, whose balance that gives.  An iterative
traversal counts members, leaves and savings from the bottom up.  A node that a
neighbouring shard holds too lies on the path of that shard's nearest word; the
shards' parts of such nodes add up, as each shard knows which of them an earlier
shard has already counted.

A long conversation is cut into words of ``SEGMENT`` turns.  The trees of later
words are named by a sum of hashes of all words before, which a running sum
gives in any number of tasks; their totals are carried back along the words of
one member of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import small_side, stored
from wayfind.llm.places import placed
from wayfind.operators.scale import Ordered, join_lookup

SEGMENT = 256
SHARD_WORDS = 20_000
SHARD_TURNS = 200_000
CODE = 32
HEADS = 9
FAMILY = 5
PIECE_BYTES = 1 << 20

NODES = (
    "id string, parent string, depth bigint, n bigint, conv bigint, children bigint, leaves bigint, saved bigint, "
    "parent_conv bigint, told boolean, shared boolean, joint boolean"
)
SHARDS = (
    "k bigint, last boolean, starts array<string>, words array<string>, sizes array<array<bigint>>, n array<bigint>, convs array<bigint>, nexts array<string>, "
    "more array<boolean>, deep array<struct<children bigint, leaves bigint, saved bigint>>, before struct<start string, word string>, after struct<start string, word string>"
)


class TernaryTree:
    """A ternary search tree of coded words; ``codes`` are numbers, the words are distinct and ascend."""

    def __init__(self, words: list[list[int]]):
        self.code: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.down: list[int] = []
        self.ends: dict[int, int] = {}
        self.top = -1
        spans = [(0, len(words))]
        while spans:  # medians first keep every level's search tree balanced
            a, b = spans.pop()
            if a < b:
                middle = (a + b) // 2
                if words[middle]:
                    self.ends[self._insert(words[middle])] = middle
                spans += [(middle + 1, b), (a, middle)]

    def _new(self, code: int) -> int:
        self.code.append(code)
        self.low.append(-1)
        self.high.append(-1)
        self.down.append(-1)
        return len(self.code) - 1

    def _insert(self, word: list[int]) -> int:
        above, at = -1, self.top
        for code in word:
            side, before = None, above
            while at >= 0 and self.code[at] != code:
                side, before = (self.low if code < self.code[at] else self.high), at
                at = side[at]
            if at < 0:
                at = self._new(code)
                if side is not None:
                    side[before] = at
                elif above >= 0:
                    self.down[above] = at
                else:
                    self.top = at
            above, at = at, self.down[at]
        return above

    def find(self, above: int, code: int) -> int:
        """The child of ``above`` (-1: the root) with ``code``; -1 if there is none."""
        at = self.top if above < 0 else self.down[above]
        while at >= 0 and self.code[at] != code:
            at = self.low[at] if code < self.code[at] else self.high[at]
        return at

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, its parent or -1, depth from 1) of all nodes, parents first, without recursion."""
        out, open_ = [], [(self.top, -1, 1)]
        while open_:
            at, above, depth = open_.pop()
            if at >= 0:
                out.append((at, above, depth))
                open_ += [(self.low[at], above, depth), (self.high[at], above, depth), (self.down[at], at, depth + 1)]
        return out


def named(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def coded(word: str) -> list[str]:
    return [word[k:k + CODE] for k in range(0, len(word), CODE)]


def shard_nodes(start: str, words: list[str], sizes: list, n: list[int], convs: list[int], nexts: list, more: list[bool], deep: list,
                before: str | None, after: str | None, segment: int) -> list[tuple]:
    """One shard's part of the nodes of the tree ``start``; ``before`` and ``after`` are the nearest words of other shards, if any."""
    split = [coded(w) for w in words]
    dictionary = {c: k for k, c in enumerate(sorted({c for w in split for c in w}))}
    tree = TernaryTree([[dictionary[c] for c in w] for w in split])
    texts = sorted(dictionary)
    walk = tree.walk()
    size = len(tree.code) + 1
    root = size - 1  # the tree's own start is kept in the last place, which is what -1 names
    members, least = [0] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    byte, shared, seen = [0] * size, [False] * size, [False] * size

    def on_path(word: str | None, earlier: bool) -> None:
        if word is None:
            return
        at, found = -1, root
        while True:
            shared[found] = True
            seen[found] = seen[found] or earlier
            rest = word[:CODE]
            at = tree.find(at, dictionary[rest]) if rest in dictionary else -1
            if at < 0:
                return
            found, word = at, word[CODE:]

    on_path(before, True)
    on_path(after, False)
    going_on = [False] * size
    if after is not None:
        at = -1
        for c in coded(after):
            going_on[at] = True
            at = tree.find(at, dictionary[c]) if c in dictionary else -1
            if at < 0:
                break
    for at, k in tree.ends.items():
        members[at], least[at] = n[k], convs[k]
    if words and not words[0]:
        members[root], least[root] = n[0], convs[0]
    # The turns' sizes come from any word below: the first that passes.
    first_word = [-1] * size
    for at, k in tree.ends.items():
        first_word[at] = k
    level = [0] * size
    for at, above, depth in reversed(walk):
        level[at] = depth
        k = first_word[at]
        byte[at] = sizes[k][depth - 1]
        first_word[above] = max(first_word[above], k)
        members[above] += members[at]
        least[above] = least[at] if least[above] is None else min(least[above], least[at])
        own = members[at] * byte[at] - (0 if seen[at] else byte[at])
        end = tree.ends.get(at)
        if end is not None and more[end]:
            if deep[end] is not None:
                children[at] += deep[end]["children"]
                leaves[at] += deep[end]["leaves"]
                saved[at] += deep[end]["saved"]
        elif tree.down[at] < 0 and not going_on[at]:
            leaves[at] += 1
        saved[at] += own
        children[above] += 0 if seen[at] else 1
        leaves[above] += leaves[at]
        saved[above] += saved[at]
    if not walk and not going_on[root] and not seen[root]:
        leaves[root] += 1
    base = int(start.split(":", 1)[0]) * segment if start else 0
    prefix = hashlib.md5((start + "/").encode())
    state, ids = [None] * size, [""] * size
    state[root], ids[root] = prefix, named(start) if start else prefix.hexdigest()
    out = [(ids[root], None, base, members[root], least[root], children[root], leaves[root], saved[root], None, True, shared[root], start != "")]
    for at, above, depth in walk:
        state[at] = state[above].copy()
        state[at].update(texts[tree.code[at]].encode())
        end = tree.ends.get(at)
        ids[at] = named(nexts[end]) if end is not None and nexts[end] is not None else state[at].hexdigest()
        known = not shared[above] and not (above < 0 and start != "")
        out.append((ids[at], ids[above], base + depth, members[at], least[at], children[at], leaves[at], saved[at], least[above] if known else None, known, shared[at], False))
    return out


def _shards(words: DataFrame, shard_words: int, shard_turns: int) -> DataFrame:
    """Range shards of (start, word, ...), one bounded row each, with the nearest words of the shards beside."""
    names = ["start", "word", "sizes", "n", "conv", "next", "more", "deep"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("k", pa.int64()), ("last", pa.bool_()), ("starts", pa.list_(pa.string())), ("words", pa.list_(pa.string())),
            ("sizes", pa.list_(pa.list_(pa.int64()))), ("n", pa.list_(pa.int64())), ("convs", pa.list_(pa.int64())), ("nexts", pa.list_(pa.string())),
            ("more", pa.list_(pa.bool_())), ("deep", pa.list_(pa.struct([("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))),
            ("before", pa.struct([("start", pa.string()), ("word", pa.string())])), ("after", pa.struct([("start", pa.string()), ("word", pa.string())])),
        ])
        rows: list[tuple] = []
        k, turns, before = 0, 0, None

        def told(after: dict | None) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip([k, after is None, *columns, before, after], schema)], schema=schema
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.select(names).columns]):
                if len(rows) >= shard_words or turns >= shard_turns:
                    yield told({"start": row[0], "word": row[1]})
                    before = {"start": rows[-1][0], "word": rows[-1][1]}
                    k, turns = k + 1, 0
                    rows.clear()
                rows.append(row)
                turns += 1 + len(row[1]) // CODE
        if rows:
            yield told(None)

    ranged = words.select(*names).repartitionByRange("start", "word").sortWithinPartitions("start", "word")
    shards = stored(ranged.mapInArrow(pack, SHARDS).withColumn("part", F.spark_partition_id()))
    # A partition's first and last shard have their neighbours in other partitions: two words per partition.
    edges = shards.where("k = 0 or last").groupBy("part").agg(
        F.min_by(F.struct(F.col("starts")[0].alias("start"), F.col("words")[0].alias("word")), "k").alias("first"),
        F.max_by(F.struct(F.element_at("starts", -1).alias("start"), F.element_at("words", -1).alias("word")), "k").alias("final"),
    )
    in_order = Window.orderBy("part")
    edges = edges.select("part", F.lag("final").over(in_order).alias("_before"), F.lead("first").over(in_order).alias("_after"))
    joined = shards.join(F.broadcast(edges), "part")
    return joined.withColumn("before", F.when(F.col("k") == 0, F.col("_before")).otherwise(F.col("before"))).withColumn(
        "after", F.when(F.col("last"), F.col("_after")).otherwise(F.col("after"))
    ).drop("part", "_before", "_after")


def _nodes(words: DataFrame, segment: int, shard_words: int, shard_turns: int) -> DataFrame:
    """All shards' parts of nodes, see ``NODES``."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in NODES.split(", ")])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.slice(r, 1).to_pylist()[0]
                starts = shard["starts"]
                a = 0
                while a < len(starts):
                    b = a
                    while b < len(starts) and starts[b] == starts[a]:
                        b += 1
                    start = starts[a]
                    before, after = shard["before"], shard["after"]
                    found = shard_nodes(
                        start, *[shard[c][a:b] for c in ("words", "sizes", "n", "convs", "nexts", "more", "deep")],
                        before["word"] if a == 0 and before and before["start"] == start else None,
                        after["word"] if b == len(starts) and after and after["start"] == start else None, segment,
                    )
                    for c in range(0, len(found), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[c:c + 50_000]), schema)], schema=schema)
                    a = b

    return stored(_shards(words, shard_words, shard_turns).mapInArrow(grow, NODES))


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )


def _lane(first: int) -> Column:
    """A number below 2^60 from a word and its place."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "seg", "word").cast("binary")), first, 15), 16, 10).cast("decimal(20,0)")


def words_of(turns: DataFrame, segment: int) -> DataFrame:
    """(conv, seg, start, word, sizes, next, more) of rows (conv, pos, code, bytes, length): the words of every conversation."""
    cut = turns.groupBy("conv", F.floor(F.col("pos") / segment).cast("bigint").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code", "bytes"))).alias("t"), F.max("length").alias("length")
    )
    cut = stored(cut.select("conv", "seg", "length", F.array_join("t.code", "").alias("word"), F.col("t.bytes").alias("sizes")))
    short = cut.where(F.col("length") < segment).select("conv", "seg", F.lit("").alias("start"), "word", "sizes", F.lit(None).cast("string").alias("next"), F.lit(False).alias("more"))
    sums = Ordered(cut.where(F.col("length") >= segment).withColumn("a", _lane(1)).withColumn("b", _lane(16)), ["conv"], ["seg"], split_on=F.col("seg"))
    sums = sums.running("sa", F.col("a")).running("sb", F.col("b")).result()
    name = lambda at, a, b: F.concat_ws(":", at, a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    long = sums.select(
        "conv", "seg",
        F.when(F.col("seg") == 0, F.lit("")).otherwise(name(F.col("seg"), F.col("sa") - F.col("a"), F.col("sb") - F.col("b"))).alias("start"),
        "word", "sizes",
        F.when(F.size("sizes") == segment, name(F.col("seg") + 1, F.col("sa"), F.col("sb"))).alias("next"),
        (F.col("length") > (F.col("seg") + 1) * segment).alias("more"),
    )
    return short.unionByName(long)


def _deep(words: DataFrame, segment: int, shard_words: int, shard_turns: int) -> DataFrame:
    """(id, children, leaves, saved) of every later word's tree, with all that follows below it."""
    later = words.where("start <> ''")
    own = stored(_merged(_nodes(_distinct(later), segment, shard_words, shard_turns).where("joint")).select("id", "children", "leaves", "saved"))
    rows = later.select("conv", "seg", F.md5(F.col("start").cast("binary")).alias("id"))
    # One member of each tree carries its totals to the trees that it passed before.
    heads = stored(rows.groupBy("id").agg(F.min("conv").alias("head")).join(own, "id"))
    rows = join_lookup(rows, heads, ["id"])
    mine = F.col("conv") == F.col("head")
    carried = Ordered(
        rows.withColumn("back", -F.col("seg")).withColumn("l", F.when(mine, F.col("leaves")).otherwise(0)).withColumn("s", F.when(mine, F.col("saved")).otherwise(0)),
        ["conv"], ["back"], split_on=F.col("back"),
    ).running("all_leaves", F.col("l")).running("all_saved", F.col("s")).result()
    return carried.groupBy("id").agg(F.first("children").alias("children"), F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("saved"))


def _distinct(words: DataFrame) -> DataFrame:
    """Equal words of one tree are one row with their number and least conversation."""
    none = F.lit(None).cast("struct<children bigint, leaves bigint, saved bigint>")
    return words.groupBy("start", "word").agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.first("next").alias("next"), F.max("more").alias("more"),
    ).withColumn("deep", none)


def trie_nodes(words: DataFrame, segment: int = SEGMENT, shard_words: int = SHARD_WORDS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node of the trie over the words of ``words_of``: ``id, depth, conv, parent_conv, n, children, leaves, saved``."""
    distinct = _distinct(words)
    if words.where("start <> ''").limit(1).count():
        deep = stored(_deep(words, segment, shard_words, shard_turns).select(F.col("id").alias("at"), F.struct("children", "leaves", "saved").alias("below")))
        full = join_lookup(distinct.where("next is not null").withColumn("at", F.md5(F.col("next").cast("binary"))), deep, ["at"], "left")
        distinct = distinct.where("next is null").unionByName(full.withColumn("deep", F.col("below")).drop("at", "below"))
    parts = _nodes(distinct, segment, shard_words, shard_turns)
    merged = stored(_merged(parts.where("shared and not joint")))
    whole = parts.where("not shared and not joint")
    parents = merged.select(F.col("id").alias("parent"), F.col("conv").alias("above"))
    parents = parents.unionByName(whole.where(F.col("depth") % segment == 0).select(F.col("id").alias("parent"), F.col("conv").alias("above")))
    columns = ["id", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved"]
    asking = whole.where("not told").select("parent", *[c for c in columns if c != "parent_conv"])
    asking = asking.unionByName(merged.where("parent is not null").select(*asking.columns))
    answered = join_lookup(asking, parents, ["parent"]).withColumnRenamed("above", "parent_conv").select(*columns)
    root = merged.where("parent is null").withColumn("parent_conv", F.lit(None).cast("bigint")).select(*columns)
    # A root is told that it has no parent.
    return whole.where("told").select(*columns).unionByName(answered).unionByName(root)


def ends_of(words: DataFrame) -> DataFrame:
    """(id, conv) of the node at which every conversation ends."""
    last = words.where("not more")
    return last.select(
        F.when(F.col("next").isNotNull(), F.md5(F.col("next").cast("binary"))).otherwise(F.md5(F.concat("start", F.lit("/"), "word").cast("binary"))).alias("id"), "conv",
    )


def joined_digests(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ascending conversations of each id, joined by commas.

    Ids are dealt out in ranges with their conversations.  What lies inside a
    partition is finished there; texts of a partition's first and last id go on
    in pieces, which one task per id reads one after the other: the digest of
    one text is a chain, but none is ever held whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, ids, size = None, 0, [], 0
        alone = False  # whether the id began after the partition's first row, in no pieces yet
        done: list[tuple] = []

        def piece_told() -> None:
            nonlocal pieces, size, alone
            done.append((now, pieces, ",".join(ids), None))
            pieces, size, alone = pieces + 1, 0, False
            ids.clear()

        def finished(last: bool) -> None:
            if ids and alone and not last:
                done.append((now, 0, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
                ids.clear()
            elif ids:
                piece_told()

        def told() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["id", "k", "piece", "sha"])
            done.clear()
            return out

        for batch in batches:
            for one, conv in zip(batch.column("id").to_pylist(), batch.column("conv").to_pylist()):
                if one != now:
                    finished(False)
                    alone, now, pieces, size = now is not None, one, 0, 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if size >= PIECE_BYTES:
                    piece_told()
                if len(done) >= 20_000:
                    yield told()
        finished(True)
        if done:
            yield told()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for one, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist()):
                if one != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = one, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
        if now is not None:
            done.append((now, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["id", "ends_sha256"])

    ranged = rows.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    found = stored(ranged.mapInArrow(read, "id string, k bigint, piece string, sha string").withColumn("part", F.spark_partition_id()))
    pieces = found.where("piece is not null").repartition("id").sortWithinPartitions("id", "part", "k").select("id", "piece")
    whole = found.where("sha is not null").select("id", F.col("sha").alias("ends_sha256"))
    return whole.unionByName(pieces.mapInArrow(chain, "id string, ends_sha256 string"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, code, bytes, length) of the rebuilt conversations, and the (conv) left without any.

    ``rows`` are placed turns (conv, pos, code, bytes).  Conversation c takes the
    first h turns of conversation c - c % 5 and its own after its first h, with
    h the crc32 of its number modulo 9.  The first conversation of a family lends
    at most eight turns to each of the others, whatever its length.
    """
    sizes = stored(rows.groupBy("conv").agg((F.max("pos") + 1).alias("n")))
    base = F.col("conv") - F.col("conv") % FAMILY
    lenders = sizes.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("lent"))
    convs = sizes.withColumn("base", base).join(lenders, "base", "left").withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    convs = convs.withColumn("m", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = stored(convs.select("conv", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = join_lookup(rows, convs, ["conv"]).where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "code", "bytes", "length")
    family = F.array(*[F.try_add(F.col("conv"), F.lit(k)) for k in range(1 - FAMILY, FAMILY)])
    heads = rows.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).withColumn("base", F.col("conv")).withColumn("conv", F.explode(family))
    heads = heads.where(F.col("conv") - F.col("conv") % FAMILY == F.col("base")).drop("base")
    heads = join_lookup(heads, convs, ["conv"]).where("pos < h").select("conv", "pos", "code", "bytes", "length")
    return own.unionByName(heads), convs.where("length = 0").select("conv")


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, code, bytes): turns by number, null first, then by digest; null role or text is empty."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    code = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, CODE)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), code.alias("code"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    return placed(rows, "conv", ["turn", "code"], "pos")


def conversation_trie(turns: DataFrame, segment: int = SEGMENT, shard_words: int = SHARD_WORDS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of rows (conv_id, turn, role, text).

    Per node: ``conv_id`` (least member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.  Turns are ordered by
    ``turn``, null first; turns with equal numbers by a digest of role and text,
    and repeated rows are turns of their own.  Null role or text is empty.  Rows
    without a conv_id belong to no conversation.  Other columns are not read.
    An empty table has no nodes.
    """
    rows, turnless = rebuilt(placed_turns(turns))
    none = turnless.select(
        "conv", F.lit(0).cast("bigint").alias("seg"), F.lit("").alias("start"), F.lit("").alias("word"), F.array().cast("array<bigint>").alias("sizes"),
        F.lit(None).cast("string").alias("next"), F.lit(False).alias("more"),
    )
    words = stored(words_of(rows, segment).unionByName(none))
    nodes = trie_nodes(words, segment, shard_words, shard_turns)
    nodes = nodes.join(joined_digests(ends_of(words)), "id", "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
