"""JSON-lines sources and sinks; nested entries to rows."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.functions.schema import PROPERTIES

MESSAGE = "struct<role:string,content:string>"
DEFINITION = f"struct<name:string,description:string,parameters:struct<properties:{PROPERTIES},required:array<string>>>"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_ragged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines whose fields change shape, as one string per field.

    The shapes are told apart later, see :func:`messages` and :func:`definitions`.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_slice(df: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    """``n`` entries after the first ``offset``, in a fixed order.

    The order is cut into ranges, one per shuffle partition, whose rows are
    counted.  Ranges before the offset are skipped whole; only the ranges that
    the slice touches are read again and cut at its edges.
    """
    place = F.struct(order)
    ranged = df.select(place.alias("_at")).repartitionByRange("_at").groupBy(F.spark_partition_id().alias("_part"))
    ranges = ranged.agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high"))
    told = ranges.orderBy("low").collect()  # one row per range
    skipped, touched = 0, []
    for r in told:
        if not touched and skipped + r["n"] <= offset:
            skipped += r["n"]
        elif not touched or skipped + sum(x["n"] for x in touched) < offset + n:
            touched.append(r)
    if not touched:
        return df.limit(0)
    edges = df.sparkSession.createDataFrame([(touched[0]["low"], touched[-1]["high"])], T.StructType([
        T.StructField("_low", ranges.schema["low"].dataType), T.StructField("_high", ranges.schema["high"].dataType)]))
    # One row of edges beside every row: a lookup of one row, not a join of two tables.
    inside = df.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one")
    inside = inside.where((place >= F.col("_low")) & (place <= F.col("_high"))).select(*[F.col(f"`{c}`") for c in df.columns])
    return inside.orderBy(order).offset(offset - skipped).limit(n)


def read_categories(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | str) -> DataFrame:
    """One file or folder per category, with the category as a column, in one scan of all."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = []
    for name, path in paths.items():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        whole = place.getFileSystem(conf).makeQualified(place).toUri().toString()
        names += [F.lit(re.sub("^file:/+", "file:/", whole)), F.lit(name)]
    table = F.create_map(*names)
    read = spark.read.schema(schema).json(list(paths.values()))
    # Some file systems are told with more slashes than others.
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    return read.withColumn("category", F.coalesce(F.element_at(table, file), F.element_at(table, F.regexp_replace(file, "/[^/]*$", ""))))


def list_categories(spark: SparkSession, path: str, by: str) -> dict[str, str]:
    """The folders ``by=value`` below ``path``, by value, from the file system's listing."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    found = [f.getPath() for f in listed if f.isDirectory() and f.getPath().getName().startswith(f"{by}=")]
    return {unquote(p.getName().split("=", 1)[1]): p.toString() for p in found}


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, one folder per value of ``by``."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def turns_of(question: Column) -> Column:
    """Question JSON as an array of turns, each an array of messages.

    Accepts turns of messages, a flat list of messages (one turn) and a bare
    string (one user message).
    """
    nested = F.from_json(question, f"array<array<{MESSAGE}>>")
    flat = F.from_json(question, f"array<{MESSAGE}>")
    bare = F.struct(F.lit("user").alias("role"), question.alias("content"))
    start = F.regexp_extract(question, r"^\s*(\[\s*\[|\[\s*\{|\[\s*\])?", 1)
    return (
        F.when(F.regexp_replace(start, r"\s", "") == "[[", nested)
        .when(F.regexp_replace(start, r"\s", "") == "[{", F.array(flat))
        .when(F.regexp_replace(start, r"\s", "") == "[]", F.array().cast(f"array<array<{MESSAGE}>>"))
        .otherwise(F.array(F.array(bare)))
    )


def messages(entries: DataFrame, key: str, turns: Column) -> DataFrame:
    """``(key, turn, msg, role, content)``: entries flattened to messages."""
    by_turn = entries.select(key, F.posexplode(turns).alias("turn", "_m"))
    rows = by_turn.select(key, "turn", F.posexplode("_m").alias("msg", "m"))
    return rows.select(key, "turn", "msg", "m.role", "m.content")


def turn_query(utterances: DataFrame, key: str, pick: str = "first") -> DataFrame:
    """The user's query of each turn.

    ``first``, ``last``: first or last user message of the turn, else its last
    message; ``entry_last``: last user message of the whole entry, else its last
    message; ``message_0``: the first message whatever its role.
    """
    user = F.col("role") == "user"
    at = F.struct("turn", "msg")
    if pick == "entry_last":
        last = F.max_by(F.when(user, F.col("content")), F.when(user, at))
        return utterances.groupBy(key).agg(F.coalesce(last, F.max_by("content", at)).alias("query"))
    if pick == "message_0":
        chosen = F.min_by("content", "msg")
    elif pick in ("first", "last"):
        by = F.min_by if pick == "first" else F.max_by
        chosen = F.coalesce(by(F.when(user, F.col("content")), F.when(user, F.col("msg"))), F.max_by("content", "msg"))
    else:
        raise ValueError(f"unknown pick {pick}")
    return utterances.groupBy(key, "turn").agg(chosen.alias("query"))


def definitions(entries: DataFrame, key: str, function: Column) -> DataFrame:
    """``(key, pos, def)``: function definitions, unwrapped.

    The JSON may be a list, a single object, a JSON string of either, or hold
    ``{type, function}`` envelopes.
    """
    text = F.coalesce(
        F.when(F.startswith(F.trim(function), F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), function, F.lit("]")), "array<string>"), F.lit(0))),
        function,
    )
    listed = F.when(F.startswith(F.trim(text), F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    item = f"struct<name:string,description:string,parameters:struct<properties:{PROPERTIES},required:array<string>>,function:{DEFINITION}>"
    rows = entries.select(key, F.posexplode(F.from_json(listed, f"array<{item}>")).alias("pos", "d"))
    plain = F.struct("d.name", "d.description", "d.parameters")
    return rows.select(key, "pos", F.coalesce("d.function", plain).alias("def"))
