"""S-*: sources and sinks; K-03; R-*: streams.

Files go to a new folder next to the cluster's checkpoints.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from wayfind.config import shared_folder
from wayfind.functions import calls as C
from wayfind.functions import schema as SC
from wayfind.functions import text as X
from wayfind.operators import features as E
from wayfind.operators import metrics as M
from wayfind.operators import mining as B
from wayfind.operators import sets as S
from wayfind.operators.scale import micros
from wayfind.plans import sqltext as Q
from wayfind.plans.join_plans import NUMBERED
from wayfind.plans.metric_plans import CATEGORIES, WEIGHTS_SQL, category_results
from wayfind.plans.registry import query
from wayfind.plans.session_plans import PATHS, folder
from wayfind.plans.similarity_plans import benchmark_words, part_catalog
from wayfind.plans.rule_plans import part_rules
from wayfind.plans.text_plans import event_call, part_properties
from wayfind.sources import catalog as K
from wayfind.sources import jsonl as J
from wayfind.sources import results as R
from wayfind.streaming import io, metrics, routes, sessions

CONVERSATION = "conv_id bigint, turn bigint, text string, role string"


@query("s01_read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def s01(t):
    path = shared_folder(t.spark)
    J.write_jsonl(t.conversations, path)
    return J.read_jsonl(t.spark, path, CONVERSATION)


@query("s01_read_ragged", """
SELECT CAST(conv_id AS VARCHAR) AS id, arg_min(text, turn) FILTER (WHERE turn = 0) AS first, CAST(count(*) AS BIGINT) AS messages FROM conversations GROUP BY conv_id
""")
def s01_ragged(t):
    """One line per conversation; its question is a list of turns, a list of messages, or a text, with blank lines between."""
    path = shared_folder(t.spark)
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("ms"))
    flat = F.to_json(F.transform("ms", lambda m: m["m"]))
    nested = F.concat(F.lit("["), flat, F.lit("]"))
    text = F.concat(F.lit('{"id":"'), "conv_id", F.lit('","question":'), F.when(F.col("conv_id") % 2 == 0, flat).otherwise(nested), F.lit("}"))
    lists.select(F.concat(text, F.lit("\n")).alias("value")).write.text(path)
    found = J.messages(J.read_ragged(t.spark, path, "id string, question string"), "id", J.turns_of(F.col("question")))
    first = F.min_by("content", "msg")
    return found.groupBy("id").agg(first.alias("first"), F.count(F.lit(1)).alias("messages"))


@query("s02_read_slice", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 20")
def s02(t):
    rows = t.conversations.withColumn("at", F.struct("conv_id", "turn"))
    return J.read_slice(rows, "at", 50, 20).select("conv_id", "turn", "text")


@query("s03_read_categories", "SELECT event_type AS category, event_id, value FROM events")
def s03(t):
    path = shared_folder(t.spark)
    J.write_jsonl(t.events.select("event_id", "value", "event_type"), path, "event_type")
    return J.read_categories(t.spark, J.list_categories(t.spark, path, "event_type"), "event_id bigint, value double")


def entries(t):
    """Conversations as benchmark entries, their question in one of three shapes.

    Two messages make a turn; an entry is one JSON line, the whole conversation.
    """
    message = F.struct("role", F.col("text").alias("content"))
    conv = t.conversations.withColumn("conv_id", F.col("conv_id").cast("string"))
    pairs = conv.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    pairs = pairs.select("conv_id", "pair", F.transform("ms", lambda m: m["m"]).alias("ms"))
    whole = pairs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pair", "ms"))).alias("ps"))
    nested = F.transform("ps", lambda p: p["ms"])
    shape = F.col("conv_id").cast("bigint") % 3
    question = (
        F.when(shape == 0, F.to_json(nested)).when(shape == 1, F.to_json(F.flatten(nested)))
        .otherwise(F.get(F.get(nested, F.lit(0)), F.lit(0))["content"])
    )
    return whole.select("conv_id", question.alias("question"))


UTT = """cv AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, conv_id % 3 AS shape, turn, role, text FROM conversations),
utt AS (
 SELECT conv_id, turn // 2 AS turn, turn % 2 AS msg, role, text AS content FROM cv WHERE shape = 0
 UNION ALL SELECT conv_id, 0, turn, role, text FROM cv WHERE shape = 1
 UNION ALL SELECT conv_id, 0, 0, 'user', arg_min(text, turn) FROM cv WHERE shape = 2 GROUP BY conv_id)"""


def utterances(t):
    out = J.messages(entries(t), "conv_id", J.turns_of(F.col("question")))
    return out.withColumn("turn", F.col("turn").cast("bigint")).withColumn("msg", F.col("msg").cast("bigint"))


@query("s04_messages", f"WITH {UTT} SELECT * FROM utt")
def s04(t):
    return utterances(t)


@query("s05_turn_query", f"""
WITH {UTT} SELECT conv_id, turn, 'first' AS pick, coalesce(arg_min(content, msg) FILTER (WHERE role = 'user'), arg_max(content, msg)) AS query FROM utt GROUP BY ALL
UNION ALL SELECT conv_id, turn, 'last', coalesce(arg_max(content, msg) FILTER (WHERE role = 'user'), arg_max(content, msg)) FROM utt GROUP BY ALL
UNION ALL SELECT conv_id, turn, 'message_0', arg_min(content, msg) FROM utt GROUP BY ALL
UNION ALL SELECT conv_id, -1, 'entry_last', coalesce(arg_max(content, (turn, msg)) FILTER (WHERE role = 'user'), arg_max(content, (turn, msg))) FROM utt GROUP BY conv_id
""")
def s05(t):
    u = utterances(t)
    out = J.turn_query(u, "conv_id", "entry_last").select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("entry_last").alias("pick"), "query")
    for pick in ("first", "last", "message_0"):
        out = out.unionByName(J.turn_query(u, "conv_id", pick).select("conv_id", "turn", F.lit(pick).alias("pick"), "query"))
    return out


@query("s06_definitions", """
SELECT p_partkey, 0 AS pos, p_type || '.' || replace(p_name, ' ', '_') AS name, 'a,brand_name,partKey,size' AS params FROM part
UNION ALL SELECT p_partkey, 1, p_brand, '' FROM part WHERE p_size % 4 = 3
""")
def s06(t):
    parameters = F.struct("props").alias("p")
    one = F.struct("name", "description", F.struct(F.col("props").alias("properties")).alias("parameters"))
    parts = part_catalog(t).join(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    plain = F.to_json(one)
    shape = F.col("p_size") % 4
    wrapped = F.concat(F.lit('[{"type":"function","function":'), plain, F.lit("}]"))
    two = F.concat(F.lit("["), plain, F.lit(',{"name":"'), "p_brand", F.lit('"}]'))
    quoted = F.regexp_extract(F.to_json(F.struct(plain.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    text = F.when(shape == 0, plain).when(shape == 1, wrapped).when(shape == 2, quoted).otherwise(two)
    out = J.definitions(parts.select("p_partkey", text.alias("f")), "p_partkey", F.col("f"))
    keys = F.coalesce(F.array_join(F.array_sort(F.map_keys("def.parameters.properties")), ","), F.lit(""))
    return out.select("p_partkey", "pos", "def.name", keys.alias("params"))


@query("s07_write_jsonl_by_class", "SELECT event_type AS class_dir, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def s07(t):
    path = shared_folder(t.spark)
    J.write_jsonl(t.events.select("event_id", "value", F.col("event_type").alias("class_dir")), path, "class_dir")
    back = J.read_jsonl(t.spark, path, "event_id bigint, value double, class_dir string")
    return back.groupBy("class_dir").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def catalog_rows(t):
    return t.events.select(F.col("event_type").alias("class_dir"), F.col("user_id").alias("func_name"), "value", F.col("event_id").alias("version"))


LATEST = "SELECT event_type AS class_dir, user_id AS func_name, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY ALL"


@query("s08_upsert", LATEST)
def s08(t):
    rows = catalog_rows(t)
    old = K.latest(rows.where("version % 3 = 0"), ["class_dir", "func_name"], ["version"])
    merged = K.upsert(old, rows, ["class_dir", "func_name"])
    return merged.select("class_dir", "func_name", "value", "version")


@query("s08_upsert_stored", LATEST)
def s08_stored(t):
    path, keys = shared_folder(t.spark), ["class_dir", "func_name"]
    rows = catalog_rows(t)
    K.write_catalog(K.latest(rows.where("version % 3 = 0"), keys, ["version"]), path)
    K.upsert_catalog(t.spark, path, rows, keys)
    return K.read_catalog(t.spark, path).select("class_dir", "func_name", "value", "version")


@query("s09_refresh", "SELECT source AS class_dir, count(*) AS n FROM documents GROUP BY source")
def s09(t):
    path = shared_folder(t.spark)
    docs = t.documents.select("doc_id", F.col("source").alias("class_dir"), "lang")
    K.write_catalog(docs.where("doc_id % 2 = 0"), path)
    K.write_catalog(docs, path)
    return K.read_catalog(t.spark, path).groupBy("class_dir").agg(F.count(F.lit(1)).alias("n"))


def stored_documents(t):
    path = shared_folder(t.spark)
    K.write_catalog(t.documents.select("doc_id", F.col("source").alias("class_dir"), "lang"), path)
    return path


@query("s10_read_class", "SELECT doc_id, source AS class_dir, lang FROM documents WHERE source = 'src3'")
def s10(t):
    return K.read_catalog(t.spark, stored_documents(t), ["src3"])


@query("s11_read_classes", "SELECT doc_id, source AS class_dir, lang FROM documents WHERE source IN ('src1', 'src4', 'src7')")
def s11(t):
    return K.read_catalog(t.spark, stored_documents(t), ["src1", "src4", "src7"])


def result_rows(t):
    """Events as result records: one per (conversation, day)."""
    correct = F.col("user_id") % 3 == 0
    rows = t.events.groupBy("user_id", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("value").alias("latency"), F.min_by(event_call(), F.struct("ts", "event_id")).alias("call"))
    category = F.when(correct, "memory_kv").when(F.col("user_id") % 3 == 1, "simple").otherwise("multi_turn_base")
    return rows.select(
        category.alias("category"), F.concat(F.lit("memory_"), "user_id", F.lit("-"), "day").alias("id"), F.array("call").alias("result"),
        correct.alias("correct"), F.lit(None).cast("string").alias("error"), (F.col("api_calls") * 10).alias("input_tokens"),
        (F.col("day") * 2).cast("bigint").alias("output_tokens"), "api_calls", "latency",
    )


@query("s12_export", """
SELECT category, count(*) AS n, CAST(sum(k) * 10 AS BIGINT) AS input_tokens, count(*) FILTER (WHERE category = 'memory_kv') AS renamed, CAST(sum(k) AS BIGINT) AS calls FROM (
 SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER), count(*) AS k, CASE user_id % 3 WHEN 0 THEN 'memory_kv' WHEN 1 THEN 'simple' ELSE 'multi_turn_base' END AS category FROM events GROUP BY user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)) GROUP BY category
""")
def s12(t):
    path = shared_folder(t.spark)
    R.export(result_rows(t), path)
    result = J.read_jsonl(t.spark, f"{path}/result", "id string, input_token_count bigint, category string")
    log = J.read_jsonl(t.spark, f"{path}/log", "id string, api_calls bigint, category string")
    sums = result.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_token_count").alias("input_tokens"), F.count(F.when(F.startswith("id", F.lit("memory_kv_")), 1)).alias("renamed"))
    return sums.join(log.groupBy("category").agg(F.sum("api_calls").alias("calls")), "category")


@query("s13_export_names", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'agentic/memory/kv' WHEN 'view' THEN 'agentic/web_search' WHEN 'error' THEN 'live' WHEN 'signup' THEN 'non_live' ELSE 'multi_turn' END AS folder,
 CASE event_type WHEN 'click' THEN 'memory_kv_' || event_id WHEN 'view' THEN 'web_search_base_' || event_id WHEN 'signup' THEN 'simple_' || event_id ELSE 'x_' || event_id END AS id,
 CASE event_type WHEN 'click' THEN 'memory_kv' WHEN 'view' THEN 'web_search_base' WHEN 'error' THEN 'live_simple' WHEN 'signup' THEN 'simple_python' ELSE 'multi_turn_base' END AS name FROM events
""")
def s13(t):
    kind = F.col("event_type")
    category = F.when(kind == "click", "memory_kv").when(kind == "view", "web_search_base").when(kind == "error", "live_simple").when(kind == "signup", "simple").otherwise("multi_turn_base")
    prefix = F.when(kind == "click", "memory_").when(kind == "view", "web_search_").when(kind == "signup", "simple_").otherwise("x_")
    return t.events.select("event_id", R.export_group(category).alias("folder"), R.export_id(category, F.concat(prefix, "event_id")).alias("id"), R.export_name(category).alias("name"))


@query("s14_round_trip", """
SELECT 'memory_' || user_id || '-' || day AS id FROM (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, arg_min(event_type, (ts, event_id)) AS f FROM events GROUP BY ALL)
WHERE (f IN ('click', 'view')) <> (user_id % 3 = 0)
""")
def s14(t):
    path = shared_folder(t.spark)
    rows = result_rows(t)
    R.export(rows, path)
    func = C.call_name(F.get("result", F.lit(0)))
    truth = rows.select("id", F.when(func.isin("click", "view"), func).otherwise("other").alias("func"))
    return R.round_trip(t.spark, path, truth, rows.select("id", "correct")).select("id")


@query("s15_summary", f"""
WITH {CATEGORIES}, {WEIGHTS_SQL}, sec AS (SELECT section, avg(acc) AS score FROM cat GROUP BY section)
SELECT (SELECT count(*) FROM cat) AS categories, (SELECT CAST(sum(n) AS BIGINT) FROM cat) AS total, (SELECT round(sum(score * weight) / sum(weight), 6) FROM sec JOIN w USING (section)) AS overall
""")
def s15(t):
    weights = t.spark.createDataFrame(list(M.SECTION_WEIGHTS.items()), "section string, weight double")
    cats = M.accuracy(category_results(t), ["section", "sub_section", "category"])
    doc = R.summary(cats.select("category", "total", "correct", "accuracy"), M.composite(cats, weights))
    parsed = doc.select(F.from_json("document", "categories map<string,struct<total:bigint,correct:bigint>>, scores struct<overall:double>").alias("d"))
    total = F.aggregate(F.map_values("d.categories"), F.lit(0).cast("bigint"), lambda a, v: a + v["total"])
    return parsed.select(F.size("d.categories").alias("categories"), total.alias("total"), F.round("d.scores.overall", 6).alias("overall"))


@query("k03_expected_tools", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|k' WHEN 2 THEN event_type ELSE event_type || '|other' END AS tools FROM events
""")
def k03(t):
    call = event_call()
    shape = F.col("event_id") % 4
    as_list = F.to_json(F.array(call, call))
    as_map = F.to_json(F.array(F.create_map(F.col("event_type"), F.lit("x")), F.create_map(F.lit("k"), F.lit("1"))))
    both = F.to_json(F.array(call, F.lit("other(a=1)")))
    truth = F.when(shape == 0, as_list).when(shape == 1, as_map).when(shape == 2, call).otherwise(both)
    return t.events.select("event_id", F.array_join(C.expected_tools(truth), "|").alias("tools"))


@query("b10_encode_catalog", "SELECT p_type AS class_dir, count(*) AS functions FROM part GROUP BY p_type")
def b10(t):
    path = shared_folder(t.spark)
    enc = E.encode_functions(part_catalog(t), "p_partkey", part_rules(t, 0, 0), part_rules(t, 1, 2))
    rows = enc.join(t.part.select("p_partkey", F.col("p_type").alias("class_dir")), "p_partkey").withColumn("version", F.lit(1))
    K.write_catalog(rows, path)
    K.upsert_catalog(t.spark, path, rows.withColumn("version", F.lit(2)), ["class_dir", "p_partkey"])
    stored = K.read_catalog(t.spark, path).where("version = 2")
    return stored.groupBy("class_dir").agg(F.count(F.lit(1)).alias("functions"))


# ---- streams -------------------------------------------------------------

def _stream(t, name):
    return io.file_stream(t.spark, f"{t.folder}/{name}*.parquet", getattr(t, name).schema)


def _shuffled(t, key, files=3):
    """The events as a stream of files, dealt by a hash of ``key`` and read one at a time."""
    path = shared_folder(t.spark)
    t.events.repartition(files, F.xxhash64(key)).write.parquet(path)
    return io.file_stream(t.spark, path, t.events.schema, files_per_trigger=1)


@contextmanager
def keyed_state(spark):
    """The RocksDB state store, for the streams started inside."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, sessions.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query("r01_route_stream", f"""
WITH q AS (SELECT conv_id || '-' || turn AS key, {Q.bag_items(Q.tokenize('text'))} AS words FROM conversations WHERE role = 'user'),
c AS (SELECT item_id AS key, {Q.bag_items(Q.tokenize('text'))} AS words FROM benchmark), {Q.all_scores(E.MEMORY)} {Q.top_k(2)}
""")
def r01(t):
    spoken = _stream(t, "conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), X.bag_items(X.tokenize(F.col("text"))).alias("words"))
    path = routes.route_stream(spoken, lambda: benchmark_words(t), E.MEMORY, "key", "item_id", 2, shared_folder(t.spark))
    return t.spark.read.parquet(path).drop("batch")


@query("r02_session_stream", f"""
WITH RECURSIVE {PATHS}, f AS (SELECT user_id, event_type, min(turn) AS first FROM ev GROUP BY ALL),
cb AS (SELECT e.user_id, e.turn, e.event_id, coalesce(string_agg(f.event_type, '|' ORDER BY f.event_type), '') AS called FROM ev e LEFT JOIN f ON f.user_id = e.user_id AND f.first < e.turn GROUP BY ALL)
SELECT cb.user_id AS conversation, cb.event_id AS call, cb.turn, {Q.joined('path', '/')} AS path, called FROM cb JOIN walk USING (user_id, turn)
""")
def r02(t):
    """The calls come in files that are not in the order of their times."""
    calls = _shuffled(t, "event_id").select(F.col("user_id").alias("conversation"), "event_id", "ts", F.col("event_type").alias("func"), folder().alias("folder"))
    place = shared_folder(t.spark)
    with keyed_state(t.spark):
        io.drain(sessions.session_stream(calls), place, lambda b, n: io.replace_batch(b, n, f"{place}/state"))
    return sessions.current(t.spark.read.parquet(f"{place}/state"))


@query("r03_metrics_stream", """
SELECT event_type, count(*) AS total, CAST(sum(CAST(value < 10 AS INTEGER)) AS BIGINT) AS correct, round(avg(value), 6) AS mean, avg(CAST(value < 10 AS INTEGER)) AS accuracy, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type
""")
def r03(t):
    """The results come in files that are not in the order of their times."""
    results = _shuffled(t, "event_id").select("event_id", "event_type", (F.col("value") < 10).alias("ok"), "value")
    with keyed_state(t.spark):
        path = metrics.metrics_stream(results, "event_id", "event_type", "ok", "value", shared_folder(t.spark))
    report = metrics.report(t.spark.read.parquet(path), "event_type", "ok", "value")
    return report.withColumn("mean", F.round("mean", 6))


@query("r04_catalog_updates", LATEST)
def r04(t):
    keys = ["class_dir", "func_name"]
    updates = _stream(t, "events").select(F.col("event_type").alias("class_dir"), F.col("user_id").alias("func_name"), "value", F.col("event_id").alias("version"))
    path = metrics.catalog_updates(updates, keys, ["version"], shared_folder(t.spark))
    return K.latest(t.spark.read.parquet(path).drop("batch"), keys, ["version"])
