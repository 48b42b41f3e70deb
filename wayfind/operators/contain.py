"""Which texts hold which other texts, by the rarest run of words of each.

A text that contains another also contains the words inside it (all but the
first and the last, which may be cut) in a row.  Of the runs of a searched text,
the one that the fewest texts hold becomes its key; texts give away only runs
that are keys, and what meets is verified by the whole of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import rules as R
from wayfind.operators.scale import checked_literals, join_lookup

RUN = 2
INLINE_KEYS = 20_000


def _words(col: Column) -> Column:
    return F.split(col, rf"[{X.SPACE}]+")


def runs(words: str) -> Column:
    """Hashes of each two words in a row of a column of words, each once; none where there are fewer."""
    ahead = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    here = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(here, ahead, lambda a, b: F.xxhash64(a, b)))


def contained_in(texts: DataFrame, key: str, text: str, wanted: DataFrame, wanted_key: str, wanted_text: str,
                 inline_keys: int = INLINE_KEYS, inline_rules: int = R.INLINE_RULES) -> DataFrame:
    """``(key, wanted_key)`` of all pairs in which the text holds the wanted one, both in comparable form.

    An empty wanted text is in no text.  Wanted texts without two words inside
    are looked for as phrases.
    """
    plain = wanted.select(F.col(wanted_key).alias("_w"), X.comparable(F.col(wanted_text)).alias("_wanted")).where(F.length("_wanted") > 0)
    words = _words(F.col("_wanted"))
    inner = plain.where(F.size(words) >= RUN + 2).withColumn("_inner", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    long = inner.withColumn("_runs", runs("_inner")).drop("_inner")
    told = texts.select(F.col(key).alias("_k"), X.comparable(F.col(text)).alias("_text"))
    by_run = _by_run(told, long, inline_keys)
    # Short ones: every phrase that occurs, joined back on its text.
    short = plain.where(F.size(words) < RUN + 2)
    phrases = short.select("_wanted").distinct().select(
        F.col("_wanted").alias("pattern"), F.col("_wanted").alias("canonical"), F.hash("_wanted").alias("ordinal"))
    hits = R.phrase_hits(told, "_k", F.col("_text"), phrases, "_hits", inline_rules)
    # A plain explode would make Spark test the array with a filter below, which computes it a second time.
    found = hits.select("_k", F.explode_outer("_hits.pattern").alias("_wanted")).where(F.col("_wanted").isNotNull())
    by_phrase = join_lookup(found, short, ["_wanted"]).select("_k", "_w")
    return by_run.unionByName(by_phrase).select(F.col("_k").alias(key), F.col("_w").alias(wanted_key))


def _by_run(told: DataFrame, long: DataFrame, inline_keys: int) -> DataFrame:
    asked = long.select("_w", "_wanted", F.explode("_runs").alias("_run"))
    every = told.withColumn("_words", _words(F.col("_text"))).withColumn("_runs", runs("_words")).drop("_words")
    held = checked_literals(asked.select("_run").distinct(), inline_keys)
    given = every.select("_k", F.explode_outer(_inside("_runs", held)).alias("_run")).where(F.col("_run").isNotNull())
    if held is None:
        given = join_lookup(given, asked.select("_run").distinct(), ["_run"], "left_semi")
    counts = given.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # A run that no text holds ends the search for its text at once.
    counted = asked.join(counts, "_run", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = counted.groupBy("_w", "_wanted").agg(F.min(F.struct("_n", "_run")).alias("_r")).where("_r._n > 0")
    keyed = rarest.select("_w", "_wanted", F.col("_r._run").alias("_run"))
    keys = checked_literals(keyed.select("_run").distinct(), inline_keys)
    if keys is not None:  # texts stay where they are: only those with a key go on, with their hits
        met = every.select("_k", "_text", F.explode_outer(_inside("_runs", keys)).alias("_run")).where(F.col("_run").isNotNull())
        pairs = join_lookup(met, keyed, ["_run"])
    else:
        met = join_lookup(every.select("_k", F.explode_outer("_runs").alias("_run")).where(F.col("_run").isNotNull()), keyed, ["_run"])
        pairs = met.join(told, "_k")
    return pairs.where(F.contains("_text", F.col("_wanted"))).select("_k", "_w").distinct()


def _inside(column: str, values: list | None) -> Column:
    """The items of an array that are among ``values`` (None: all)."""
    if values is None:
        return F.col(column)
    return F.filter(column, lambda x: x.isin(values)) if values else F.array().cast("array<bigint>")
