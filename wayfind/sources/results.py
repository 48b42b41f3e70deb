"""Export of evaluation results, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.operators import sets as S
from wayfind.sources.jsonl import write_jsonl

# Categories that carry another name in exported files.
EXPORT_NAMES = {"simple": "simple_python", "java": "simple_java", "javascript": "simple_javascript"}
NON_LIVE = ("simple_python", "simple_java", "simple_javascript", "multiple", "parallel", "parallel_multiple", "irrelevance")


def export_name(category: Column) -> Column:
    out = category
    for name, exported in EXPORT_NAMES.items():
        out = F.when(category == name, exported).otherwise(out)
    return out


def export_group(category: Column) -> Column:
    """Folder of a category."""
    name = export_name(category)
    return (
        F.when(name.isin(*NON_LIVE), "non_live")
        .when(F.startswith(name, F.lit("live_")), "live")
        .when(F.startswith(name, F.lit("multi_turn_")), "multi_turn")
        .when(F.startswith(name, F.lit("memory_")), F.concat(F.lit("agentic/memory/"), F.replace(name, F.lit("memory_"), F.lit(""))))
        .when(F.startswith(name, F.lit("web_search")), "agentic/web_search")
        .otherwise("non_live")
    )


def export_id(category: Column, entry: Column) -> Column:
    """Entry id with its category as prefix: ``memory_0`` -> ``memory_kv_0``."""
    name = export_name(category)
    out = entry
    for prefix in ("web_search_", "memory_"):
        renames = F.startswith(name, F.lit(prefix)) & ~F.startswith(entry, name)
        # Only the first occurrence of the prefix is replaced.
        at = F.instr(entry, prefix)
        renamed = F.when(at > 0, F.concat(
            F.substr(entry, F.lit(1), at - 1), name, F.lit("_"), F.substr(entry, at + len(prefix)))).otherwise(entry)
        out = F.when(renames, renamed).otherwise(out)
    return out


def export(results: DataFrame, path: str) -> None:
    """Result files and detailed logs, one folder per category each."""
    result = results.select(
        "category", export_id(F.col("category"), F.col("id")).alias("id"), "result",
        F.col("input_tokens").alias("input_token_count"), F.col("output_tokens").alias("output_token_count"), "latency",
    )
    log = results.select(
        "category", "id", F.col("correct").alias("passed"), "error", "result", "input_tokens", "output_tokens", "api_calls",
        F.col("latency").alias("latency_s"),
    )
    write_jsonl(result, f"{path}/result", "category")
    write_jsonl(log, f"{path}/log", "category")


def round_trip(spark: SparkSession, path: str, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """Entries whose exported result no longer gives the recorded decision.

    Reads the log back, decodes the call strings, compares them with the truth
    ``(id, func)`` as multisets and returns the disagreements.
    """
    log = spark.read.schema("id string, passed boolean, result array<string>, category string").json(f"{path}/log")
    calls = log.select("id", F.explode("result").alias("call")).select("id", C.call_name(F.col("call")).alias("func"))
    again = S.multiset_equal(S.counts(calls, truth, ["id"], "func"), ["id"])
    return scored.join(again, "id", "left").where(~F.coalesce("equal", F.lit(True)).eqNullSafe(F.col("correct")))


def summary(categories: DataFrame, composite: DataFrame) -> DataFrame:
    """One JSON document: a map of categories and the overall score.

    There are as many categories as exported files, a few dozen.
    """
    fields = [c for c in categories.columns if c != "category"]
    entries = F.array_sort(F.collect_list(F.struct("category", F.struct(*fields).alias("v"))))
    by_category = categories.agg(F.map_from_entries(entries).alias("categories"))
    overall = composite.agg(F.first(F.struct(*composite.columns)).alias("scores"))
    both = by_category.unionByName(overall, allowMissingColumns=True).agg(
        F.first("categories", ignorenulls=True).alias("categories"), F.first("scores", ignorenulls=True).alias("scores")
    )
    return both.select(F.to_json(F.struct("categories", "scores")).alias("document"))
