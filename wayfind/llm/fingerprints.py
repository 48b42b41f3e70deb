"""Order MinHash fingerprints, in SQL functions only.

The runs of a text are the ``K`` characters up to each of its characters (fewer
at its start), at every size and in every script.  They are numbered by
occurrence, so that each is distinct, and hashed with that number.  Each of ``M`` permutations selects the ``L`` smallest;
these are put back into their order in the text and hashed as a tuple.  Two
fingerprints are alike in the share of equal tuples, which falls both when the
content and when its order changes, as edit distance does.

The permutations are rotations of one random order, at even distances: the
smallest after a rotation are the first hashes from its start on, around the
end.  Every run is equally likely to be the smallest, one sort serves all
permutations, and no text is hashed ``M`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
L = 2
M = 32  # a power of two
NEAR = 24
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
TASK_ROWS = 4_000


def runs(text: Column, k: int = K) -> Column:
    """Hashes of the ``k`` characters up to each one, in text order; an empty text has one empty run."""
    padded = F.concat(F.lit("\x01" * (k - 1)), text)
    found = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))  # takes one code point at a time
    return F.transform(F.when(text == "", F.array(F.lit(""))).otherwise(found), lambda x: F.xxhash64(x))


def _packed(value: Column, place: Column) -> Column:
    """The upper bits of a hash, with a place in the lower ones."""
    return F.shiftleft(F.shiftright(value, PLACE_BITS), PLACE_BITS).bitwiseOR(place.bitwiseAND(F.lit(PLACE).cast("bigint")))


def with_fingerprint(df: DataFrame, text: Column, name: str, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """Add ``name``: the fingerprint of a text, null for a null text."""
    return from_runs(df.withColumn(f"_{name}_runs", runs(text, k)), f"_{name}_runs", name, l, m).drop(f"_{name}_runs")


def from_runs(df: DataFrame, runs_col: str, name: str, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """Add ``name``: an array of ``m`` tuple hashes of the runs in ``runs_col``, null for null runs.

    Places beyond 16.7 million characters wrap, which only changes the order in
    which such runs are hashed.
    """
    s, d, b, e, u, w, o = (f"_{name}_{x}" for x in "sdbeuwo")
    part = (1 << 64) // m  # of all hashes, from one start to the next
    low = F.lit(part - 1).cast("bigint")
    # Only the first hashes after a start are ever looked at: of many runs those near one are kept, some NEAR after each
    # start, before anything is sorted. That one of them has fewer than two has a chance of 1e-9; then the next near one counts.
    size = F.size(F.col(runs_col))
    df = df.withColumn(e, F.when(size <= m * NEAR, F.lit(part).cast("bigint")).otherwise((F.lit(float(part * m * NEAR)) / size).cast("bigint")))
    kept = F.transform(F.col(runs_col), lambda x, i: F.when(x.bitwiseAND(low) < F.col(e), _packed(x, i.cast("bigint"))))
    df = df.withColumn(s, F.sort_array(F.array_compact(kept)))
    run = lambda v: F.shiftright(v, PLACE_BITS)
    # runs that were there before, and where each new one of these starts, and the end
    df = df.withColumn(d, F.filter(F.col(s), lambda v, i: (i > 0) & (run(F.get(F.col(s), i - 1)) == run(v))))
    heads = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (run(F.get(F.col(d), i)) != run(F.get(F.col(d), i - 1))))
    df = df.withColumn(b, F.when(F.size(d) > 0, F.concat(heads, F.array(F.size(d)))))
    numbers = F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda j: F.sequence(F.lit(1), F.get(F.col(b), j + 1) - F.get(F.col(b), j))))
    # One number per (run, occurrence), with its place in the text: the first occurrence keeps the run's hash, a later
    # one goes behind another start, as far behind it as the first, so that both are near or neither is.
    bits = m.bit_length() - 1
    moved = lambda v, k: v.bitwiseXOR(F.shiftleft(F.xxhash64(run(v), k).bitwiseAND(F.lit(m - 1).cast("bigint")), 64 - bits))
    again = F.zip_with(F.col(d), numbers, moved)
    first = F.filter(F.col(s), lambda v, i: (i == 0) | (run(F.get(F.col(s), i - 1)) != run(v)))
    df = df.withColumn(u, F.when(F.col(b).isNull(), F.col(s)).otherwise(F.sort_array(F.concat(first, again))))
    n = F.size(u)
    starts = [(-1 << 63) + seed * part for seed in range(m)]
    with_starts = F.sort_array(F.concat(F.col(u), F.array(*[F.lit(x).cast("bigint") for x in starts])))
    df = df.withColumn(w, with_starts).withColumn(o, F.concat(F.col(u), F.slice(F.col(u), 1, l)))
    tuples = []
    for seed, start in enumerate(starts):
        below = (F.array_position(F.col(w), F.lit(start).cast("bigint")) - 1 - seed).cast("int")
        at = F.when(below >= n, 0).otherwise(below)
        found = F.array_compact(F.array(*[F.get(F.col(o), at + j).bitwiseAND(F.lit(PLACE).cast("bigint")) for j in range(l)]))
        places = F.sort_array(found)
        tuples.append(F.xxhash64(F.transform(places, lambda p: F.get(F.col(runs_col), p.cast("int")))))
    return df.withColumn(name, F.when(F.col(runs_col).isNotNull(), F.array(*tuples))).drop(s, d, b, e, u, w, o)


def edited_runs(body: Column, following: Column, own: Column, n: Column, half: Column, k: int = K) -> Column:
    """The runs of a text whose last ``half`` characters are replaced by the first as many of ``following``.

    What stays keeps its runs; runs inside the new part are those of the other
    text; only the ``k`` - 1 after the seam are new.
    """
    stays = n - half
    pattern = F.lit(f"(?s)(?=(.{{{k}}})).")
    left = F.when(stays >= k - 1, F.substring(body, stays - (k - 2), F.lit(k - 1))).otherwise(
        F.right(F.concat(F.lit("\x01" * (k - 1)), F.substring(body, F.lit(1), stays)), F.lit(k - 1))
    )
    seam = F.concat(left, F.substring(following, F.lit(1), F.least(half, F.lit(k - 1))))
    inside = F.substring(following, F.lit(1), half)
    hashed = lambda text: F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.xxhash64(x))
    return F.when(n == 0, own).otherwise(F.concat(F.slice(own, F.lit(1), stays), hashed(seam), hashed(inside)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples at the same position, 0 to 1; null if either is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when(a.isNotNull() & b.isNotNull(), same / F.size(a))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """``id``, ``body`` and ``next_body``, the text after it in descending id order; and the window that orders them.

    After the last comes the first.  Null ids come last, equal ids in the order
    of their texts' hashes.  The ids are cut at quantiles into buckets of about
    ``TASK_ROWS`` rows (at most four per shuffle partition); each bucket is
    ordered by itself, with the first row of the next bucket after its end (as
    a row with ``ghost`` = 1).  So texts are shuffled once, and no task sees more
    than a bucket.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    rows = base.count()
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(-(-rows // TASK_ROWS), most))
    cuts: list = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        cuts = base.agg(F.percentile_approx("id", F.array(*[F.lit(x) for x in at]), 10_000)).first()[0] or []
    # An id with many rows, or null with many, is a bucket of its own, cut by its texts' hashes: fewer than rows / TASK_ROWS ids.
    hot = base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * TASK_ROWS).collect()
    cuts = sorted({*cuts, *[r.id - 1 for r in hot if r.id is not None], *[r.id for r in hot if r.id is not None]})
    above = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    pieces = F.lit(1)
    for r in hot:
        pieces = F.when(F.col("id").eqNullSafe(F.lit(r.id)), F.lit(-(-r.n // TASK_ROWS))).otherwise(pieces)
    placed = base.withColumn("tie", F.xxhash64("body")).withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(above).cast("int"))
    placed = placed.withColumn("piece", F.floor((F.col("tie").cast("double") / 2.0 ** 64 + 0.5) * pieces).cast("int"))
    # the first row of each bucket: highest id, then highest hash
    firsts = placed.groupBy("bucket", "piece").agg(F.max(F.struct("id", "tie")).alias("top"))
    tops = sorted(firsts.collect(), key=lambda r: (-r.bucket, -r.piece))  # one narrow row per bucket
    ends = [(tops[k - 1].bucket, tops[k - 1].piece, t.bucket, t.piece, t.top.id, t.top.tie) for k, t in enumerate(tops)]  # the last bucket ends with the first
    ghosts = spark.createDataFrame(ends, "to_bucket int, to_piece int, bucket int, piece int, id bigint, tie bigint")
    same = [placed[c].eqNullSafe(F.col(f"g.{c}")) for c in ("bucket", "piece", "id", "tie")]
    heads = (
        placed.join(F.broadcast(ghosts.alias("g")), same[0] & same[1] & same[2] & same[3])
        .groupBy(F.col("to_bucket").alias("bucket"), F.col("to_piece").alias("piece")).agg(F.min("body").alias("body"))
        .select(F.lit(None).cast("bigint").alias("id"), "body", F.lit(0).cast("bigint").alias("tie"), "bucket", "piece", F.lit(1).alias("ghost"))
    )
    everything = placed.withColumn("ghost", F.lit(0)).unionByName(heads)
    order = Window.partitionBy("bucket", "piece").orderBy("ghost", F.desc_nulls_last("id"), F.desc("tie"))
    return everything.withColumn("next_body", F.lead("body").over(order)), order


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    as many from the start of the next text in descending id order (all of it,
    if that is shorter).  Null text is empty; an empty text has the fingerprint
    of one empty run.  Repeated rows are documents of their own; a single
    document is its own next one.  An empty table gives no rows.
    """
    pairs, order = with_next(docs, id_col, text_col)
    n, half = F.col("n"), F.col("half")
    pairs = pairs.withColumn("n", F.length("body")).withColumn("half", F.floor(n / 2).cast("int")).withColumn("runs", runs(F.col("body")))
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next_body"), F.lit(1), half))
    pairs = from_runs(pairs, "runs", "own")
    pairs = pairs.withColumn("edited_sha256", F.sha2(edited, 256)).withColumn("runs", edited_runs(F.col("body"), F.col("next_body"), F.col("runs"), n, half))
    pairs = from_runs(pairs.drop("body", "next_body"), "runs", "changed").drop("runs")
    # The same order as before, so nothing moves for it.
    pairs = pairs.withColumn("next_own", F.lead("own").over(order)).where("ghost = 0")
    return pairs.select(
        F.col("id").alias(id_col),
        n.cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
