import json

from pyspark.sql import functions as F

from tests.conftest import rows
from wayfind.operators import session as T
from wayfind.sources import catalog as K
from wayfind.sources import jsonl as J
from wayfind.sources import results as R
from wayfind.streaming import io, metrics, sessions


def test_ragged_entries(spark, tmp_path):
    entries = [
        {"id": "a", "question": [[{"role": "system", "content": "s"}, {"role": "user", "content": "u1"}, {"role": "user", "content": "u2"}], [{"role": "assistant", "content": "x"}]]},
        {"id": "b", "question": [{"role": "user", "content": "flat"}]},
        {"id": "c", "question": "bare"},
        {"id": "d", "question": []},
    ]
    path = tmp_path / "e.jsonl"
    path.write_text("\n\n".join(json.dumps(e) for e in entries) + "\n\n")
    df = J.read_ragged(spark, str(path), "id string, question string")
    assert df.count() == 4
    m = J.messages(df, "id", J.turns_of(F.col("question")))
    assert rows(J.turn_query(m, "id", "first")) == [("a", 0, "u1"), ("a", 1, "x"), ("b", 0, "flat"), ("c", 0, "bare")]
    assert rows(J.turn_query(m, "id", "last"))[0] == ("a", 0, "u2")
    assert rows(J.turn_query(m, "id", "message_0"))[0] == ("a", 0, "s")
    assert rows(J.turn_query(m, "id", "entry_last")) == [("a", "u2"), ("b", "flat"), ("c", "bare")]


def test_definitions_unwrap(spark):
    plain = '{"name":"f","parameters":{"properties":{"a":{"type":"integer"}}}}'
    shapes = [plain, f"[{plain},{plain}]", '[{"type":"function","function":' + plain + "}]", json.dumps(plain)]
    df = spark.createDataFrame(list(enumerate(shapes)), "k int, f string")
    out = rows(J.definitions(df, "k", F.col("f")).select("k", "pos", "def.name", F.map_keys("def.parameters.properties")[0]))
    assert out == [(0, 0, "f", "a"), (1, 0, "f", "a"), (1, 1, "f", "a"), (2, 0, "f", "a"), (3, 0, "f", "a")]


def test_export_ids(spark):
    df = spark.createDataFrame([("memory_kv", "memory_0-x_memory_1"), ("memory_kv", "memory_kv_0"), ("web_search_base", "web_search_4"), ("java", "java_1")], "c string, i string")
    out = [r[0] for r in df.select(R.export_id(F.col("c"), F.col("i"))).collect()]
    assert out == ["memory_kv_0-x_memory_1", "memory_kv_0", "web_search_base_4", "java_1"]


def test_stored_upsert_leaves_other_classes_alone(spark, tmp_path):
    path = str(tmp_path / "cat")
    schema = "class_dir string, func_name string, v int, version int"
    K.write_catalog(spark.createDataFrame([("a", "f", 1, 1), ("b", "g", 1, 1)], schema), path)
    K.upsert_catalog(spark, path, spark.createDataFrame([("a", "f", 5, 2), ("a", "h", 6, 2), ("a", "f", 4, 1)], schema), ["class_dir", "func_name"])
    assert rows(K.read_catalog(spark, path).select("class_dir", "func_name", "v")) == [("a", "f", 5), ("a", "h", 6), ("b", "g", 1)]
    plan = K.read_catalog(spark, path, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(class_dir" in plan


def events(spark):
    data = [(c, c * 100 + i, i, "fgh"[(i + c) % 3], ["a", "..", "b", "."][(i * 7 + c) % 4]) for c in (1, 2) for i in range(20)]
    return spark.createDataFrame(data, "conversation long, event_id long, ts long, func string, folder string")


def test_session_stream_over_several_batches_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    df = events(spark)
    source = str(tmp_path / "in")
    for part in (2, 0, 3, 1):  # not the order of the times
        df.where(F.floor(F.col("ts") / 5) == part).coalesce(1).write.mode("append").parquet(source)
    stream = io.file_stream(spark, source, df.schema, files_per_trigger=1)
    io.drain(sessions.session_stream(stream), str(tmp_path), lambda b, n: io.replace_batch(b, n, str(tmp_path / "out")))
    got = rows(sessions.current(spark.read.parquet(str(tmp_path / "out"))).select("conversation", "turn", "path", "called"))
    numbered = df.withColumn("turn", F.col("ts") + 1)
    paths = T.working_path(numbered, "conversation", "turn", F.col("folder"))
    called = T.called_before(numbered, "conversation", "func", "turn")
    want = rows(paths.join(called, ["conversation", "turn"]).select("conversation", "turn", F.array_join("path", "/"), F.array_join("called", "|")))
    assert got == want


def test_metrics_stream_counts_a_repeated_result_once(spark, tmp_path):
    data = [(i % 6, f"2024-01-01 00:00:0{i % 6}", "k", i % 2 == 0, float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(data, "id long, at string, cat string, ok boolean, s double").withColumn("at", F.to_timestamp("at"))
    source = str(tmp_path / "in")
    df.where("id < 4").coalesce(1).write.parquet(source)
    df.coalesce(1).write.mode("append").parquet(source)
    stream = io.file_stream(spark, source, df.schema, files_per_trigger=1)
    path = metrics.metrics_stream(stream, "id", "cat", "ok", "s", str(tmp_path))
    row = metrics.report(spark.read.parquet(path), "cat", "ok", "s").first()
    assert (row.total, row.correct, row.mean, row.p95) == (6, 3, 1.0, 2.0)


def test_metrics_stream_counts_late_results(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, day in enumerate((100, 0, 50)):
        late = spark.range(k * 100, k * 100 + 100).select("id", F.date_add(F.lit("2024-01-01"), day).alias("at"), F.lit("k").alias("cat"), F.lit(True).alias("ok"), F.lit(1.0).alias("s"))
        late.coalesce(1).write.mode("append").parquet(source)
    stream = io.file_stream(spark, source, late.schema, files_per_trigger=1)
    path = metrics.metrics_stream(stream, "id", "cat", "ok", "s", str(tmp_path))
    assert metrics.report(spark.read.parquet(path), "cat", "ok", "s").first().total == 300


def test_slices_skip_whole_ranges(spark):
    df = spark.range(1_000).select(((F.col("id") * 37) % 1_000).alias("k"), F.lit("x").alias("v")).repartition(5)
    for offset, n in ((0, 3), (990, 30), (499, 2), (250, 600), (1_000, 5), (0, 0), (2_000, 1)):
        assert sorted(r.k for r in J.read_slice(df, "k", n, offset).collect()) == list(range(1_000))[offset:offset + n], (offset, n)
    nulls = spark.createDataFrame([(None, 1), (2, 2), (None, 3), (1, 4)], "k int, v int")
    assert [r.k for r in J.read_slice(nulls, "k", 3, 1).collect()] == [None, 1, 2]
    pairs = df.withColumn("at", F.struct("v", "k"))
    assert [r.k for r in J.read_slice(pairs, "at", 2, 700).select("k").collect()] == [700, 701]


def test_categories_in_one_scan(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "a b"), (2, "c/d"), (3, "a b")], "id int, kind string")
    J.write_jsonl(rows_, str(tmp_path / "t"), "kind")
    paths = J.list_categories(spark, str(tmp_path / "t"), "kind")
    assert sorted(paths) == ["a b", "c/d"]
    found = J.read_categories(spark, paths, "id int")
    assert rows(found.select("id", "category")) == [(1, "a b"), (2, "c/d"), (3, "a b")]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    (tmp_path / "one.jsonl").write_text('{"id": 7}\n\n')
    assert rows(J.read_categories(spark, {"single": str(tmp_path / "one.jsonl")}, "id int").select("id", "category")) == [(7, "single")]


def test_upsert_writes_only_touched_files_anew(spark, tmp_path):
    path = str(tmp_path / "cat")
    schema = "class_dir string, func_name string, v int, version int"
    for part in range(4):  # four files of one class
        made = spark.createDataFrame([("a", f"f{part}{k}", 0, 1) for k in range(5)], schema).coalesce(1)
        made.write.mode("append").partitionBy("class_dir").parquet(path)
    files = lambda: {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    before = files()
    K.upsert_catalog(spark, path, spark.createDataFrame([("a", "f10", 9, 2), ("b", "new", 8, 1)], schema), ["class_dir", "func_name"])
    after = files()
    assert len(before & after) == 3
    got = {r.func_name: r.v for r in K.read_catalog(spark, path).collect()}
    assert len(got) == 21 == K.read_catalog(spark, path).count() and got["f10"] == 9 and got["new"] == 8 and got["f11"] == 0
