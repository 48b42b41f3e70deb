"""Near duplicates by DartMinHash signatures of weighted word shingles.

A text is its runs of five words with their counts as weights.  Each element is
a strip as high as its weight; darts are thrown at the plane of weight and rank,
in regions that double in both directions, from hashes of the element and the
region only.  Darts that land below an element's weight are the text's; the
earliest dart of each of ``K`` coordinates makes the signature, so two
signatures agree at a coordinate with the weighted Jaccard similarity of the
texts.  Only about K log K darts are thrown for a text, whatever its length.

Bands of a signature meet in buckets.  In each bucket all members are held
against its most connected one, and the links verified exactly.  Where members
of a bucket are not in one class after that, those outside its largest class
are held against all others, in bounded blocks that give links only; finer
bands split very large buckets first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import free_name, give_back, held, mixed, slices, small_side, stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
K = BANDS * ROWS
GOLD = np.uint64(0x9E3779B97F4A7C15)
RANK_UNIT = 2.0 ** -6


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of ``words`` lower-case words; a shorter text is one run, an empty one has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    if len(hashes) < words:
        hashes = np.concatenate([hashes, np.full(words - len(hashes), len(hashes), dtype=np.uint64)])
    out = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
    for k in range(words):
        out = mixed(out * np.uint64(31) + hashes[k:len(hashes) - words + 1 + k])
    return out


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often they occur."""
    element, count = np.unique(shingles(text), return_counts=True)
    return element, count.astype(np.float64)


def poisson_steps(area: float) -> np.ndarray:
    """The distribution function of a Poisson count with mean ``area``, up to where it is 1."""
    p, total, steps, n = np.exp(-area), np.exp(-area), [np.exp(-area)], 0
    while total < 1 - 1e-17 and n < 40 + 4 * area:
        n += 1
        p *= area / n
        total += p
        steps.append(total)
    return np.array(steps)


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def sketches(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = K, seed: int = 0) -> np.ndarray:
    """Signatures (rows x k) of weighted sets; ``row`` is the set of each element.  An empty set has all 0."""
    out = np.zeros(rows * k, dtype=np.uint64)
    mass = np.bincount(row, weight, rows)
    filled = np.repeat(mass <= 0, k)
    base = mixed(element ^ mixed(np.array([seed + 1], dtype=np.uint64)))
    heights = int(np.ceil(np.log2(max(weight.max(), 1.0)))) if len(weight) else 0
    rank_bin = 0
    open_rows = mass > 0
    needed = np.where(mass > 0, (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-300), 0)
    while open_rows.any():
        low, high = (0.0, RANK_UNIT) if rank_bin == 0 else (RANK_UNIT * 2.0 ** (rank_bin - 1), RANK_UNIT * 2.0 ** rank_bin)
        inside = np.flatnonzero(open_rows[row])
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for height in range(heights + 1):
            bottom, top = (0.0, 1.0) if height == 0 else (2.0 ** (height - 1), 2.0 ** height)
            here = inside if height == 0 else inside[weight[inside] > bottom]
            if not len(here):
                break
            region = mixed(base[here] + np.array([1 + rank_bin * 64 + height], dtype=np.uint64) * GOLD)
            count = np.searchsorted(poisson_steps((top - bottom) * (high - low)), unit(region), side="right")
            hit = np.flatnonzero(count)
            count = count[hit]
            which = np.repeat(here[hit], count)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(np.repeat(region[hit], count) + (turn.astype(np.uint64) + np.uint64(1)) * GOLD)
            below = bottom + (top - bottom) * unit(mixed(dart ^ np.uint64(0xA5A5A5A5))) < weight[which]
            dart, which = dart[below], which[below]
            rank = low + (high - low) * unit(mixed(dart ^ np.uint64(0x5A5A5A5A5A)))
            darts.append((row[which] * k + (dart % np.uint64(k)).astype(np.int64), rank, dart))
        if darts:
            key, rank, dart = (np.concatenate(x) for x in zip(*darts))
            free = np.flatnonzero(~filled[key])
            free = free[np.argsort(-rank[free], kind="stable")]  # the earliest is written last
            out[key[free]] = dart[free]
            filled[key[free]] = True
        rank_bin += 1
        done = filled.reshape(rows, k).all(axis=1)
        open_rows &= ~(done & (high >= needed)) & ~done
    return out.reshape(rows, k)


def signatures(texts: list[str], k: int = K, seed: int = 0) -> np.ndarray:
    sets = [weighted(t) for t in texts]
    row = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets]) if sets else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if sets else np.zeros(0)
    return sketches(row, element, weight, len(sets), k, seed)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per band of ``rows`` coordinates; the band's number takes part."""
    n, k = signature.shape
    out = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * GOLD, (n, k // rows)).copy()
    for j in range(rows):
        out = mixed(out * np.uint64(31) + signature[:, j::rows])
    return out.view(np.int64)


def numbered(text: str) -> np.ndarray:
    """Sorted hashes of (shingle, occurrence number): plain sets whose Jaccard is the weighted one of the shingles."""
    found = np.sort(shingles(text))
    if not len(found):
        return found
    first = np.concatenate([[True], found[1:] != found[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))
    return np.sort(mixed(found + (np.arange(len(found)) - begin).astype(np.uint64) * GOLD))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ``numbered`` sets; 0 if one is empty."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if common else 0.0


def band_table(docs: DataFrame, seed: int) -> DataFrame:
    """(id, band keys) of every row of (id, body) whose text has a shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["body"].tolist()
            for a, b in slices(map(len, texts), 500_000, 200):
                signed = signatures(texts[a:b], K, seed)
                full = signed.any(axis=1)
                if not full.any():
                    continue  # a slice of texts without a word
                yield pd.DataFrame({"id": batch["id"].to_numpy()[a:b][full], "keys": list(bands(signed[full]))})
        give_back()

    return docs.mapInPandas(run, "id bigint, keys array<bigint>")


def packed(numbers: np.ndarray) -> bytes:
    """The upper 40 bits of sorted 64-bit hashes."""
    return np.ascontiguousarray((numbers >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def set_table(docs: DataFrame) -> DataFrame:
    """(id, packed numbered shingles) of every row of (id, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1_000):
                part = batch.iloc[a:a + 1_000]
                yield pd.DataFrame({"id": part["id"], "packed": [packed(numbered(t)) for t in part["body"]]})
        give_back()

    return docs.mapInPandas(run, "id bigint, packed binary")


def links_of_group(ids: np.ndarray, labels: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links of the asking members to members of other classes, one for each pair of classes that meet.

    The members' elements are sorted once; a member's common elements with all
    others are counted from the places of its own.
    """
    sizes = np.array([len(x) for x in sets])
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    label, out = labels.copy(), []
    for q in np.flatnonzero(asks):
        if not (label != label[q]).any():
            break
        low, high = np.searchsorted(element, sets[q], "left"), np.searchsorted(element, sets[q], "right")
        n = high - low
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        common = np.bincount(owner[place], minlength=len(sets))
        alike = (common >= threshold * (sizes + sizes[q] - common) - 1e-9) & (common > 0) & (label != label[q])
        for other in np.flatnonzero(alike):
            if label[other] != label[q]:
                out.append((int(min(ids[q], ids[other])), int(max(ids[q], ids[other]))))
                label[label == label[other]] = label[q]
    return out


def links_in_groups(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) inside the groups of (g, id, label, asks): groups are bounded, and come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []

        def told() -> list[tuple[int, int]]:
            ids, labels, asks = (np.array([h[k] for h in group]) for k in (1, 2, 3))
            return links_of_group(ids, labels, asks, [unpacked(h[4]) for h in group], threshold)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in batch.itertuples(index=False, name=None):
                if group and row[0] != group[0][0]:
                    out += told()
                    group.clear()
                group.append(row)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if group:
            yield pd.DataFrame(told(), columns=["a", "b"])
        give_back()

    full = rows.join(sets, "id").select("g", "id", "label", "asks", "packed")
    return full.repartition("g").sortWithinPartitions("g", "id").mapInPandas(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ends of ``links`` (a, b): the least id each can reach.

    Every round takes the least label among the neighbours and then follows
    labels of labels, so chains halve; each round is a written table.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        once = labels.join(near, "id").select("id", "label", F.least("label", "l").alias("l"))
        jump = labels.select(F.col("id").alias("l"), F.col("label").alias("j"))
        new = stored(once.join(jump, "l").select("id", F.least("l", "j").alias("label"), (F.least("l", "j") < F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            return labels


def linked(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


BLOCK = 1_000
LARGE = 50_000
LEVELS = 6


def _block(of: str, blocks):
    return F.pmod(F.xxhash64(of), blocks)


def star_groups(rows: DataFrame) -> DataFrame:
    """Groups of a star and up to about ``BLOCK`` members that share a bucket with it; the star asks."""
    degree = rows.groupBy("id").agg(F.sum("n").alias("degree"))
    stars = rows.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("back"))).alias("top"))
    stars = stars.select("key", (-F.col("top.back")).alias("star"))
    pairs = held(rows.join(stars, "key").where("id <> star").select("star", "id").distinct())
    counts = pairs.groupBy("star").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.floor(F.col("m") / BLOCK) + 1
    members = pairs.join(counts, "star").select(F.xxhash64("star", _block("id", blocks)).alias("g"), "star", "id")
    heads = members.groupBy("g").agg(F.first("star").alias("id"))
    return members.select("g", "id", F.col("id").alias("label"), F.lit(False).alias("asks")).unionByName(
        heads.select("g", "id", F.col("id").alias("label"), F.lit(True).alias("asks"))
    )


def mixed_groups(rows: DataFrame) -> DataFrame:
    """Groups of the members (key, id, label, n) of mixed buckets; all outside a bucket's largest class ask.

    A bucket of more than ``BLOCK`` members is cut into blocks, and each two
    blocks make a group.
    """
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"))
    blocks = F.floor(F.col("n") / BLOCK) + 1
    told = rows.join(most, "key").withColumn("blocks", blocks).withColumn("mine", _block("id", blocks))
    told = told.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return told.select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "id", "label",
        (F.col("label") != F.col("most.label")).alias("asks"),
    )


def near_links(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join all rows of (id, body), distinct in both, into their classes of similar texts."""
    keyed = stored(band_table(docs, 0))
    rows = keyed.select("id", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stored(rows.join(small_side(held(met)), "key"))
    ids = held(rows.select("id").distinct())
    sets = stored(set_table(docs.join(small_side(ids), "id")))
    links: list[DataFrame] = []
    for level in range(LEVELS):
        links.append(held(links_in_groups(star_groups(rows), sets, threshold)))
        labels = components(linked(links))
        # Buckets whose members are not all in one class; of those with the same members one is enough.
        marked = rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
        left = marked.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("all"),
        ).where("low < high")
        left = held(left.groupBy("c", "all").agg(F.min("key").alias("key")).select("key"))
        if not left.limit(1).count():
            break
        mixed_rows = held(marked.join(small_side(left), "key"))
        last = level == LEVELS - 1
        few = mixed_rows if last else mixed_rows.where(F.col("n") <= LARGE)
        links.append(held(links_in_groups(mixed_groups(few), sets, threshold)))
        many = mixed_rows.where(F.col("n") > LARGE).select("key", "id")
        again = many.select("id").distinct()
        if last or not many.limit(1).count():
            break
        # Very large mixed buckets are split by bands of a new signature.
        finer = band_table(docs.join(small_side(stored(again)), "id"), level + 1).select("id", F.explode("keys").alias("finer"))
        rows = stored(many.join(finer, "id").select("id", F.xxhash64("key", "finer").alias("key")))
        met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = stored(rows.join(met, "key"))
    return linked(links)


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, text, label) of every row, and per class ``class_size`` and its first member ``top``; a null id is -2^63.

    ``text`` is a hash of the whole text: an id may stand for several texts.
    """
    base = docs.select(_id(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    hashed = base.select("id", F.unhex(F.sha2("body", 256)).alias("sha"))
    # Exact copies first: one representative per text, counted before the shuffle.
    texts = stored(hashed.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    shared = texts.where("n > 1").select("sha", "rep")
    members = stored(
        hashed.join(small_side(shared), "sha", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.xxhash64("sha").alias("text"))
    )
    # Nodes are representatives; where one id represents several texts, the text takes part in the node's name.
    repeated = texts.groupBy("rep").count().where("count > 1").limit(1).count() > 0
    node = lambda of, text: F.xxhash64(of, text) if repeated else of
    reps = texts.select(node(F.col("rep"), F.xxhash64("sha")).alias("id"))
    own = node(F.col("id"), F.xxhash64(F.unhex(F.sha2("body", 256))))
    # Most rows are representatives, so only the others are told: a copy's id, or a repeated row.
    chosen = base.select(own.alias("id"), "body")
    if members.count() > texts.count():
        chosen = chosen.join(small_side(reps, 1_000_000), "id", "left_semi").dropDuplicates(["id"])
    labels = components(near_links(chosen, threshold))
    found = members.withColumn("node", node(F.col("rep"), F.col("text")))
    found = found.join(small_side(labels.select(F.col("id").alias("node"), "label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("id", "text")).alias("top"))
    return found.join(small_side(held(sizes.where("class_size > 1"))), "label", "left")


def _id(id_col: str):
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))


def _kept():
    return F.col("top").isNull() | ((F.col("top.id") == F.col("id")) & (F.col("top.text") == F.col("text")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: id, ``class_id``, ``class_size``, ``kept``.

    Equal texts are one class, and so are texts joined by links of a weighted
    Jaccard of ``threshold`` or more over runs of five lower-case words.  Null
    text is empty; empty texts are equal to each other and like no other.  The
    class is named by its least id, whose row is ``kept`` (all rows with that
    id and its text, if rows repeat).  A null id is less than any other.  An
    empty table gives no rows.
    """
    joined = classes(docs, id_col, text_col, threshold)
    back = lambda c: F.when(c != -(1 << 63), c)
    return joined.select(
        back(F.col("id")).alias(id_col),
        back(F.coalesce("top.id", "id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        _kept().alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The ``kept`` rows of ``near_classes``, all columns as they came; of repeated rows with one id and text all stay."""
    at, of = free_name(docs, "_class_id"), free_name(docs, "_class_text")
    dropped = classes(docs, id_col, text_col, threshold).where(~_kept()).select(F.col("id").alias(at), F.col("text").alias(of))
    text = F.xxhash64(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    return docs.join(small_side(held(dropped.distinct())), (_id(id_col) == F.col(at)) & (text == F.col(of)), "left_anti")
