"""B-*: exemplar, pattern and test mining; G-12; E-04, E-06.

A turn is a conversation's day (days since 1970): its query is phrased after the first event, its
calls are the events with a large value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.config import checkpointed
from wayfind.functions import text as X
from wayfind.functions import words as W
from wayfind.operators import features as E
from wayfind.operators import metrics as M
from wayfind.operators import mining as B
from wayfind.operators import select as L
from wayfind.operators import similarity as S
from wayfind.operators.scale import micros
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query
from wayfind.plans.similarity_plans import WORDS_SQL, benchmark_words, document_words
from wayfind.plans.text_plans import EVENT_CALL, event_call

TURN = ["user_id", "day"]


def turn_queries(t):
    first = F.min_by(F.struct("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")), F.struct("ts", "event_id"))
    turns = t.events.groupBy("user_id", F.unix_date(F.to_date("ts")).alias("day")).agg(first.alias("f"))
    kind = F.col("f.event_type")
    text = F.concat(F.lit("Please "), kind, F.lit(" with "), F.col("f.k") % 4, F.lit(' "'), kind, F.lit('.txt" now'))
    action = F.when(kind == "error", "none").otherwise(F.concat(F.lit("do_"), kind))
    return turns.select(
        "user_id", "day", text.alias("query"), action.alias("action"), F.concat(F.lit("t"), F.col("f.k") % 2).alias("target"),
        F.when(kind == "view", "none").otherwise(F.concat(F.lit("d"), F.col("f.k") % 3)).alias("domain"),
    )


def turn_calls(t):
    return t.events.where("value > 18").select(
        "user_id", F.unix_date(F.to_date("ts")).alias("day"), "ts", "event_id", event_call().alias("call"), F.col("event_type").alias("func"),
    )


TURNS = f"""f AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, arg_min(event_type, (ts, event_id)) AS kind, arg_min(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, event_id)) AS k FROM events GROUP BY ALL),
tq AS (SELECT user_id, day, 'Please ' || kind || ' with ' || (k % 4) || ' "' || kind || '.txt" now' AS query, CASE WHEN kind = 'error' THEN 'none' ELSE 'do_' || kind END AS action, 't' || (k % 2) AS target,
  CASE WHEN kind = 'view' THEN 'none' ELSE 'd' || (k % 3) END AS domain FROM f),
tc AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, ts, event_id, event_type AS func, {EVENT_CALL} AS call FROM events WHERE value > 18),
pt AS (SELECT tq.*, coalesce(p, '[]') AS pattern FROM tq LEFT JOIN (SELECT user_id, day, string_agg(func, '|' ORDER BY ts, event_id) AS p FROM tc GROUP BY ALL) USING (user_id, day))"""


@query("b01_mine_queries", f"WITH {TURNS} SELECT func, query, user_id, day, event_id FROM tq JOIN tc USING (user_id, day)")
def b01(t):
    return mined(t).select("func", "query", "user_id", "day", "event_id")


def mined(t):
    return B.mine_queries(turn_queries(t), turn_calls(t).drop("func"), TURN, "call")


@query("b02_exemplar_intent", """
WITH cm AS (SELECT p_type AS cls, p_name AS func, min(p_brand) AS action, max(p_brand) AS target FROM part GROUP BY ALL HAVING min(p_size) % 2 = 0),
gm AS (SELECT p_name AS func, 'g' || (min(p_size) % 4) AS action, 'h' || (max(p_size) % 4) AS target FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_name HAVING min(p_partkey) % 3 <> 0)
SELECT p_partkey, CASE WHEN cm.func IS NOT NULL THEN cm.action ELSE coalesce(gm.action, 'none') END AS action, CASE WHEN cm.func IS NOT NULL THEN cm.target ELSE coalesce(gm.target, 'none') END AS target
FROM part LEFT JOIN cm ON cm.cls = p_type AND cm.func = p_name LEFT JOIN gm ON gm.func = p_name
""")
def b02(t):
    cm = t.part.groupBy(F.col("p_type").alias("cls"), F.col("p_name").alias("func")).agg(
        F.min("p_brand").alias("action"), F.max("p_brand").alias("target"), F.min("p_size").alias("s")).where("s % 2 = 0")
    gm = t.part.where("p_brand <> 'Brand#1'").groupBy(F.col("p_name").alias("func")).agg(
        F.concat(F.lit("g"), F.min("p_size") % 4).alias("action"), F.concat(F.lit("h"), F.max("p_size") % 4).alias("target"), F.min("p_partkey").alias("k")).where("k % 3 <> 0")
    funcs = t.part.select("p_partkey", F.col("p_type").alias("cls"), F.col("p_name").alias("func"))
    return B.exemplar_intent(funcs, cm, gm).select("p_partkey", "action", "target")


def document_catalog(t):
    cls = F.concat_ws("/", "source", "lang")
    return t.documents.select(
        cls.alias("cls"), F.col("doc_id").alias("func"), F.concat(F.lit("a"), F.col("doc_id") % 5).alias("action"), F.lit("none").alias("target"),
        X.tokenize(F.col("source")).alias("name_tokens"), X.tokenize(X.clean_description(F.col("text"))).alias("tokens"),
        F.array(F.col("lang"), F.lit("text")).alias("param_tokens"), F.col("lang").alias("class_words"),
    )


def document_queries(t):
    """Each benchmark text is a query for the documents of its number."""
    d = t.documents.select(F.col("doc_id").alias("func"), (F.col("doc_id") % 50).alias("item_id"))
    return d.join(t.benchmark, "item_id").select("func", F.col("text").alias("query"), F.col("item_id").alias("ord"))


CATALOG = f"""dc AS (SELECT source || '/' || lang AS cls, doc_id AS func, 'a' || (doc_id % 5) AS action, {Q.tokenize('source')} AS nt, {Q.tokenize(Q.clean_description('text'))} AS tk, lang FROM documents),
shared AS (SELECT cls, token FROM (SELECT cls, unnest(list_distinct(tk)) AS token FROM dc) JOIN (SELECT cls, count(*) AS size FROM dc GROUP BY cls) USING (cls) GROUP BY cls, token, size HAVING count(*) = size AND size > 1),
sl AS (SELECT cls, list(token) AS s FROM shared GROUP BY cls),
df AS (SELECT dc.*, coalesce(s, []) AS s, CASE WHEN len(list_filter(tk, lambda w: not list_contains(coalesce(s, []), w))) > 0 THEN list_filter(tk, lambda w: not list_contains(coalesce(s, []), w)) ELSE tk END AS diff FROM dc LEFT JOIN sl USING (cls))"""


@query("g12_differing_words", f"WITH {CATALOG} SELECT func, {Q.joined('diff')} AS diff FROM df")
def g12(t):
    return B.differing_words(document_catalog(t), "cls", "tokens").select("func", F.array_join("diff", " ").alias("diff"))


MINED_TOP = f"""mq AS (SELECT doc_id AS func, item_id, {Q.tokenize('b.text')} AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 50),
mp AS (SELECT func, item_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM mq),
mc AS (SELECT func, token, count(*) AS n, min(i) AS seen FROM mp GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY n DESC, seen) AS r FROM mc),
mk AS (SELECT func, token, r, row_number() OVER (PARTITION BY func ORDER BY r) AS rank FROM mr WHERE r <= 15 AND NOT EXISTS (SELECT 1 FROM df WHERE df.func = mr.func AND list_contains(df.s, mr.token))),
ml AS (SELECT func, string_agg(token, ' ' ORDER BY rank) AS m FROM mk WHERE rank <= 8 GROUP BY func)"""


B03 = f"""
WITH {CATALOG}, {{mined}},
ds AS (SELECT df.*, {Q.joined('diff')} AS d, m FROM df LEFT JOIN ml USING (func)),
dn AS (SELECT func, string_agg(w, ' ' ORDER BY i) AS nd FROM (SELECT func, w, min(i) AS i FROM (SELECT func, unnest(list_concat(nt, diff)) AS w, generate_subscripts(list_concat(nt, diff), 1) AS i FROM df) GROUP BY func, w) GROUP BY func)
SELECT cls AS class_name, cls || '.' || func AS function_name, func AS raw_name, action, 'none' AS target, {Q.joined('nt')} AS function_name_bow, lang || ' text' AS parameters_bow, v AS variant,
 CASE v WHEN 1 THEN concat(action, ' ', d, ' ', d, ' ', d, ' ', lang) WHEN 2 THEN concat(action, ' ', nd, ' ', nd, ' ', lang)
  ELSE CASE WHEN m IS NOT NULL THEN concat(action, ' ', m, ' ', m, ' ', d, ' ', lang) ELSE concat(action, ' ', lang, ' text ', d, ' ', d, ' ', lang) END END AS description
FROM ds LEFT JOIN dn USING (func), (VALUES (1), (2), (3)) x(v)
"""


@query("b03_exemplars", B03.replace("{mined}", MINED_TOP))
def b03(t):
    return B.exemplars(document_catalog(t), document_queries(t), "ord", top=(10, 15, 8))


def _uncapped(sql):
    return sql.replace("WHERE r <= 15 AND NOT EXISTS", "WHERE NOT EXISTS").replace(" WHERE rank <= 8", "")


@query("b03_exemplars_all", B03.replace("{mined}", _uncapped(MINED_TOP)))
def b03_all(t):
    """The same from all queries and all their tokens."""
    return B.exemplars(document_catalog(t), document_queries(t), "ord")


@query("b04_test_pairs", f"""
WITH {TURNS}, m AS (SELECT func, query, event_id FROM tq JOIN tc USING (user_id, day)),
d AS (SELECT func, lower(trim(query)) AS n, arg_min(trim(query), event_id) AS query, min(event_id) AS f FROM m GROUP BY ALL)
SELECT query, func AS expected_function, 'mined' AS test_type FROM (SELECT *, row_number() OVER (PARTITION BY func ORDER BY f) AS r FROM d) WHERE r <= 20
""")
def b04(t):
    return B.test_pairs(mined(t), "event_id")


def patterned(t, long_turn=B.LONG_TURN):
    calls = turn_calls(t)
    turns = B.turn_patterns(turn_queries(t), calls, TURN, "func", ["ts", "event_id"], micros("ts"), long_turn)
    return turns.withColumn("ord", F.struct("user_id", "day"))


@query("b05_mine_patterns", f"""
WITH {TURNS} SELECT pattern, count(*) AS turns, count(DISTINCT lower(trim(query))) AS queries, arg_min(query, (user_id, day)) AS first_query FROM pt GROUP BY pattern
""")
def b05(t):
    return B.mine_patterns(patterned(t), "ord")


def _pattern_sql():
    words = "CASE WHEN pattern = '[]' THEN 'none' ELSE " + Q.bag("string_split(replace(pattern, '|', ' '), ' ')") + " END"
    stop = W.STOP_WORDS + W.PATTERN_EXTRA_STOP_WORDS
    params = (
        f"list_concat(list_concat({Q.tokenize('query', stop)}, regexp_extract_all(query, '\"([^\"]*)\"', 1)), "
        "list_concat(regexp_extract_all(query, '''([^'']*)''', 1), regexp_extract_all(query, '\\b\\d+\\.?\\d*\\b')))"
    )
    return f"""x AS (SELECT *, (user_id * 100000 + day) AS o FROM pt),
dv AS (SELECT pattern, domain, count(*) AS n, min(o) AS f FROM x WHERE domain <> 'none' GROUP BY ALL),
vt AS (SELECT pattern, coalesce((SELECT domain FROM dv WHERE dv.pattern = p.pattern ORDER BY n DESC, f LIMIT 1), 'none') AS domain FROM (SELECT DISTINCT pattern FROM x) p),
fs AS (SELECT pattern, arg_min(query, o) AS query, arg_min(action, o) AS action, arg_min(target, o) AS target FROM x GROUP BY pattern),
bs AS (SELECT fs.*, domain FROM fs JOIN vt USING (pattern)),
dq AS (SELECT pattern, arg_min(query, o) AS query, arg_min(action, o) AS action, arg_min(target, o) AS target, arg_min(domain, o) AS domain, min(o) AS o FROM x GROUP BY pattern, lower(trim(query))),
kq AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY o) AS r FROM dq),
al AS (SELECT pattern, query, action, target, domain, 1 AS variant FROM bs UNION ALL SELECT pattern, query, action, target, domain, 2 FROM bs UNION ALL SELECT pattern, query, action, target, domain, r + 2 FROM kq WHERE r <= 9),
wd AS (SELECT *, {words} AS fw, {Q.bag(params)} AS parameters_bow, {Q.bag(Q.tokenize('query', stop))} AS qd FROM al),
ex AS (SELECT pattern, action, target, domain, fw AS function_name_bow, parameters_bow, variant,
 CASE WHEN variant = 2 THEN concat_ws(' ', CASE WHEN action <> 'none' THEN replace(action, '_', ' ') END, CASE WHEN fw <> 'none' THEN fw ELSE 'empty' END, CASE WHEN domain <> 'none' THEN domain END)
  ELSE CASE WHEN fw <> 'none' THEN qd || ' ' || fw ELSE qd END END AS description FROM wd)"""


@query("b06_pattern_exemplars", f"WITH {TURNS}, {_pattern_sql()} SELECT * FROM ex")
def b06(t):
    return pattern_exemplars(t)


@query("b06_pattern_exemplars_all", f"WITH {TURNS}, {_pattern_sql().replace(' WHERE r <= 9', '')} SELECT * FROM ex")
def b06_all(t):
    return pattern_exemplars(t, None)


def pattern_exemplars(t, variants=9):
    turns = patterned(t)
    votes = M.vote(turns.select("pattern", "domain", (F.col("user_id") * 100_000 + F.col("day")).alias("o")), "pattern", "domain", "o")
    return B.pattern_exemplars(turns, "ord", votes, variants, F.col("candidate_order.user_id"))


def encoded_exemplars(t, variants):
    ex = pattern_exemplars(t, variants).withColumn("key", F.concat("pattern", F.lit("__v"), "variant"))
    enc = E.encode_exemplars(ex, "key")
    return enc.select("key", "action", "target", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("function_name", "description", "parameters")])


ENCODED_EXEMPLARS = """
SELECT pattern || '__v' || variant AS key, action, target, array_to_string(list_sort(list_distinct(string_split(function_name_bow, ' '))), ' ') AS function_name,
 array_to_string(list_sort(list_distinct(string_split(description, ' '))), ' ') AS description, array_to_string(list_sort(list_distinct(string_split(parameters_bow, ' '))), ' ') AS parameters FROM ex
"""


@query("e06_encode_exemplars_all", f"WITH {TURNS}, {_pattern_sql().replace(' WHERE r <= 9', '')} {ENCODED_EXEMPLARS}")
def e06_all(t):
    return encoded_exemplars(t, None)


@query("b07_pattern_tests", f"WITH {TURNS} SELECT query, pattern AS expected, 'c' || (user_id % 4) AS category, 'u' || user_id AS entry_id, day AS turn_idx FROM pt")
def b07(t):
    return patterned(t).select(
        "query", F.col("pattern").alias("expected"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("category"),
        F.concat(F.lit("u"), "user_id").alias("entry_id"), F.col("day").alias("turn_idx"),
    )


@query("b08_task_exemplars", f"""
WITH {TURNS} SELECT user_id AS entry, day AS turn, query, {Q.joined(Q.without("string_split_regex(lower(query), '[^a-z0-9_]+')", W.TASK_STOP_WORDS))} AS query_clean, replace(pattern, '|', ',') AS pattern,
 CASE WHEN split_part(pattern, '|', 1) IN ('click', 'view') THEN 'K' || split_part(pattern, '|', 1)
  ELSE coalesce((SELECT 'K' || f FROM (SELECT unnest(string_split(pattern, '|')) AS f, generate_subscripts(string_split(pattern, '|'), 1) AS i) WHERE f IN ('click', 'view') ORDER BY i LIMIT 1), 'I' || (user_id % 3)) END AS cls
FROM pt WHERE pattern <> '[]'
""")
def b08(t):
    names = F.when(F.col("pattern") == L.EMPTY_PATTERN, F.array().cast("array<string>")).otherwise(F.split("pattern", "[|]"))
    turns = patterned(t).select(
        F.col("user_id").alias("entry"), F.col("day").alias("turn"), "query", names.alias("functions"),
        F.array(F.concat(F.lit("I"), F.col("user_id") % 3)).alias("involved"),
    )
    classes = t.events.where("event_type in ('click', 'view')").select(F.col("event_type").alias("func")).distinct().withColumn("cls", F.concat(F.lit("K"), "func"))
    return B.task_exemplars(turns, classes)


@query("b09_task_sequence", f"""
WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)}, top AS ({Q.top_k(1)})
SELECT query, CASE WHEN score >= 0.20 THEN source || ',' || lang END AS functions, score FROM top JOIN documents ON doc_id = candidate
""")
def b09(t):
    best = S.top_k(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id", 1)
    tasks = t.documents.select(F.col("doc_id").alias("task"), F.concat_ws(",", "source", "lang").alias("functions"))
    return B.task_sequence(best, tasks)


@query("e06_encode_exemplars", f"WITH {TURNS}, {_pattern_sql()} {ENCODED_EXEMPLARS}")
def e06(t):
    return encoded_exemplars(t, 9)


_TOK = Q.tokenize("query", W.STOP_WORDS + W.PATTERN_EXTRA_STOP_WORDS)

PATTERN_ROLES = f"""c AS (SELECT pattern || '__v' || variant AS key, action, target, domain, list_distinct(string_split(description, ' ')) AS description, list_distinct(string_split(parameters_bow, ' ')) AS parameters,
  list_distinct(string_split(function_name_bow, ' ')) AS function_names FROM ex),
qq AS (SELECT DISTINCT query, action, target, domain FROM pt),
q AS (SELECT query || '/' || target || '/' || domain AS key, action, target, domain, {Q.bag_items(_TOK)} AS description,
  list_distinct(list_concat(list_concat({_TOK}, regexp_extract_all(query, '"([^"]*)"', 1)), regexp_extract_all(query, '\\b\\d+\\.?\\d*\\b'))) AS parameters, ['none'] AS function_names FROM qq)"""


@query("e04_pattern_scores", f"""
WITH {TURNS}, {_pattern_sql()}, {PATTERN_ROLES}, {Q.all_scores(E.pattern_encoding())} {Q.top_k(3)}
""")
def e04(t):
    """Match each distinct query to the pattern exemplars."""
    return pattern_scores(t, 9)


@query("e04_pattern_scores_all", f"""
WITH {TURNS}, {_pattern_sql().replace(' WHERE r <= 9', '')}, {PATTERN_ROLES}, {Q.all_scores(E.pattern_encoding())} {Q.top_k(3)}
""")
def e04_all(t):
    """The same with the exemplars of all queries of a pattern."""
    return pattern_scores(t, None)


def pattern_scores(t, variants):
    ex = pattern_exemplars(t, variants).withColumn("key", F.concat("pattern", F.lit("__v"), "variant"))
    # Mining costs far more than its result: keep the encoded exemplars.
    catalog = checkpointed(E.encode_exemplars(ex, "key", with_domain=True))
    queries = turn_queries(t).select("query", "action", "target", "domain").distinct()
    queries = checkpointed(E.encode_pattern_queries(queries.withColumn("key", F.concat_ws("/", "query", "target", "domain")), "query"))
    return S.top_k(queries, catalog, E.pattern_encoding(), "key", "key", 3)
