"""T-*: conversation state in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import select as L
from wayfind.operators import session as T
from wayfind.plans import sqltext as Q
from wayfind.plans.join_plans import NUMBERED, numbered
from wayfind.plans.registry import query
from wayfind.plans.rule_plans import RULES, word_rules
from wayfind.plans.select_plans import label_count
from wayfind.plans.similarity_plans import EMBEDDING_SCORES, embedding_scores


def folder():
    """Folder argument of an event: purchases go up, errors stay, the rest enter."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    return (
        F.when(F.col("event_type").isin("purchase", "view"), "..").when(F.col("event_type") == "error", ".")
        .otherwise(F.concat(F.lit("d"), k))
    )


PATHS = f"""{NUMBERED}, op AS (SELECT user_id, turn, CASE WHEN event_type IN ('purchase', 'view') THEN '..' WHEN event_type = 'error' THEN '.' ELSE 'd' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) END AS f FROM ev),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS path FROM (SELECT DISTINCT user_id FROM op)
  UNION ALL SELECT w.user_id, o.turn, CASE WHEN f = '..' THEN list_slice(path, 1, len(path) - 1) WHEN f IN ('.', '') THEN path ELSE list_append(path, f) END FROM walk w JOIN op o ON o.user_id = w.user_id AND o.turn = w.turn + 1)"""


def paths(t):
    ev = numbered(t).withColumn("folder", folder())
    return T.working_path(ev, "user_id", "turn", F.col("folder"))


@query("t01_working_path", f"WITH RECURSIVE {PATHS} SELECT user_id, turn, {Q.joined('path', '/')} AS path FROM walk WHERE turn > 0")
def t01(t):
    return paths(t).select("user_id", "turn", F.array_join("path", "/").alias("path"))


def tree_nodes(t):
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit("directory").alias("kind"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit("directory").alias("kind"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.lit("file").alias("kind"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.lit("file").alias("kind"))
    return r.unionByName(n).unionByName(s).unionByName(c)


TREE = """leaf AS (SELECT r_name AS p, 'directory' AS kind, NULL AS up FROM region
 UNION ALL SELECT r_name || '/' || n_name, 'directory', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, 'file', r_name || '/' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 'file', r_name || '/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("t02_flatten_tree", f"WITH {TREE} SELECT p AS path, kind FROM leaf")
def t02(t):
    return T.flatten_tree(tree_nodes(t)).select(F.array_join("path", "/").alias("path"), "kind")


@query("t02_tree_contents", f"WITH {TREE} SELECT up AS path, count(*) FILTER (WHERE kind = 'file') AS n_files, count(*) FILTER (WHERE kind = 'directory') AS n_dirs FROM leaf WHERE up IS NOT NULL GROUP BY up")
def t02_contents(t):
    return T.tree_contents(T.flatten_tree(tree_nodes(t)))


_TEXT = "text || ' \"' || lang || '.txt\" ''' || source || ''' \"' || lang || '\"'"


@query("t03_mentions", f"""
WITH {RULES}, d AS (SELECT doc_id, lang, source, {_TEXT} AS t FROM documents),
qd AS (SELECT doc_id, t, list_distinct(list_concat(regexp_extract_all(t, '''([^'']*)''', 1), regexp_extract_all(t, '"([^"]*)"', 1))) AS q FROM d),
n AS (SELECT pattern AS name, ordinal % 2 = 0 AS is_file FROM rules UNION ALL SELECT 'en', true UNION ALL SELECT 'src1', false),
hit AS (SELECT doc_id, name, is_file FROM qd JOIN n ON contains(t, name)
  UNION SELECT doc_id, x, contains(x, '.') FROM (SELECT doc_id, unnest(q) AS x FROM qd) WHERE x NOT IN (SELECT name FROM n))
SELECT doc_id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE is_file), '') AS files, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE NOT is_file), '') AS dirs FROM hit GROUP BY doc_id
""")
def t03(t):
    # Visible names: as many as the rule table has rows (60), plus two fixed ones.
    rows = word_rules(t).select("pattern", "ordinal").collect()
    names = lambda even, extra: F.array(*[F.lit(r["pattern"]) for r in rows if (r["ordinal"] % 2 == 0) == even], F.lit(extra))
    text = F.concat("text", F.lit(' "'), "lang", F.lit(".txt\" '"), "source", F.lit("' \""), "lang", F.lit('"'))
    files, dirs = T.mentions(F.col("t"), names(True, "en"), names(False, "src1"))
    out = t.documents.select("doc_id", text.alias("t"))
    return out.select("doc_id", F.array_join(F.array_sort(files), "|").alias("files"), F.array_join(F.array_sort(dirs), "|").alias("dirs"))


@query("t04_path_steps", """
WITH g AS (SELECT n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT c_custkey, a.r_name AS r1, a.n_name AS n1, b.r_name AS r2, b.n_name AS n2, 'S' || (c_custkey % 2) AS leaf FROM customer JOIN g a ON a.n_nationkey = c_nationkey JOIN g b ON b.n_nationkey = (c_nationkey + c_custkey % 3 * 5) % 25)
SELECT c_custkey, CASE WHEN r1 <> r2 THEN '../../' || r2 || '/' || n2 || '/' || leaf WHEN n1 <> n2 THEN '../' || n2 || '/' || leaf ELSE leaf END AS steps FROM x
""")
def t04(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("p"))
    cust = t.customer.withColumn("other", (F.col("c_nationkey") + F.col("c_custkey") % 3 * 5) % 25)
    a = cust.join(place.select(F.col("n_nationkey").alias("c_nationkey"), F.col("p").alias("a")), "c_nationkey")
    b = a.join(place.select(F.col("n_nationkey").alias("other"), F.col("p").alias("b")), "other")
    goal = F.concat("b", F.array(F.concat(F.lit("S"), F.col("c_custkey") % 2)))
    return b.select("c_custkey", F.array_join(T.path_steps(F.col("a"), goal), "/").alias("steps"))


CHAINS = (("purchase", "signup", True), ("purchase", "view", False), ("error", "click", False))


def days(t):
    return t.events.select("user_id", F.unix_date(F.to_date("ts")).alias("day"), F.col("event_type").alias("func"), "value")


@query("t05_inject_prerequisites", f"""
WITH d AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, event_type AS func, value FROM events), c AS (SELECT DISTINCT user_id, day, func FROM d),
r(func, prereq, one_shot) AS (VALUES {", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in CHAINS)}),
f AS (SELECT user_id, func, min(day) AS first FROM d GROUP BY ALL), av AS (SELECT DISTINCT user_id, func FROM d WHERE value > 20)
SELECT DISTINCT user_id, day, prereq FROM c JOIN r USING (func)
WHERE EXISTS (SELECT 1 FROM av WHERE av.user_id = c.user_id AND av.func = prereq)
 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.user_id = c.user_id AND x.day = c.day AND x.func = prereq)
 AND NOT (one_shot AND EXISTS (SELECT 1 FROM f WHERE f.user_id = c.user_id AND f.func = prereq AND f.first < c.day))
""")
def t05(t):
    rules = t.spark.createDataFrame(list(CHAINS), "func string, prereq string, one_shot boolean")
    d = days(t)
    firsts = T.first_calls(d, "user_id", "func", "day")
    return T.inject_prerequisites(d, rules, "user_id", "day", "func", firsts, d.where("value > 20"))


@query("t06_called_before", f"""
WITH {NUMBERED}, f AS (SELECT user_id, event_type, min(turn) AS first FROM ev GROUP BY ALL)
SELECT e.user_id, e.turn, coalesce(string_agg(f.event_type, '|' ORDER BY f.event_type), '') AS called FROM ev e LEFT JOIN f ON f.user_id = e.user_id AND f.first < e.turn GROUP BY ALL
""")
def t06(t):
    out = T.called_before(numbered(t), "user_id", "event_type", "turn")
    return out.select("user_id", "turn", F.array_join("called", "|").alias("called"))


@query("t07_visible_functions", f"""
WITH {NUMBERED}, f AS (SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 0 ELSE min(turn) FILTER (WHERE value > 10) END AS from_turn FROM ev GROUP BY user_id, event_type)
SELECT e.user_id, e.turn, coalesce(string_agg(f.event_type, '|' ORDER BY f.event_type), '') AS visible FROM ev e LEFT JOIN f ON f.user_id = e.user_id AND f.from_turn <= e.turn GROUP BY ALL
""")
def t07(t):
    ev = numbered(t)
    start = F.min(F.when(F.col("value") > 10, F.col("turn")))
    funcs = ev.groupBy("user_id", F.col("event_type").alias("func")).agg(start.alias("s"))
    funcs = funcs.select("user_id", "func", F.when(F.col("func") == "click", 0).otherwise(F.col("s")).cast("int").alias("from_turn")).where("from_turn is not null")
    out = T.visible_functions(ev.select("user_id", "turn"), funcs, "user_id", "turn")
    return out.select("user_id", "turn", F.array_join("visible", "|").alias("visible"))


BASE = "b AS (SELECT query, (candidate // 2 * 2) || '|' || (candidate // 2 * 2 + 1) AS p, max(score) AS score FROM escores GROUP BY ALL), pm AS (SELECT query, p, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p) AS r FROM b) WHERE r = 1)"


def _best_pattern(t, scores, threshold):
    even = (F.floor(F.col("candidate") / 2) * 2).cast("int")
    return L.match_pattern(scores, t.embeddings.select(F.col("vec_id").alias("query")), F.concat_ws("|", even, even + 1), threshold)


@query("t08_route_turn", f"""
WITH {EMBEDDING_SCORES}, {BASE},
s5 AS (SELECT * FROM (SELECT *, candidate % 3 AS cls, row_number() OVER (PARTITION BY query, candidate % 3 ORDER BY score DESC, candidate) AS r FROM escores) WHERE r <= 5 AND score > 0.10),
cm AS (SELECT query, cls, max(score) AS cm FROM s5 GROUP BY ALL), bm AS (SELECT query, max(cm) AS best FROM cm GROUP BY query),
near AS (SELECT s5.* FROM s5 JOIN cm USING (query, cls) JOIN bm USING (query) WHERE cm >= best - CAST(0.15 AS DOUBLE)),
u AS (SELECT vec_id AS query, label AS candidate, 0 AS stage, 0.0::DOUBLE AS ord FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT query, candidate, 1, -score FROM near),
f AS (SELECT query, candidate, min((stage, ord)) AS k FROM u GROUP BY ALL)
SELECT query, 'pattern' AS source, CAST(unnest(string_split(p, '|')) AS INTEGER) AS candidate, generate_subscripts(string_split(p, '|'), 1) AS position FROM pm WHERE score >= 0.45
UNION ALL SELECT query, 'candidates', candidate, row_number() OVER (PARTITION BY query ORDER BY k, candidate) FROM f WHERE query NOT IN (SELECT query FROM pm WHERE score >= 0.45)
""")
def t08(t):
    scores = embedding_scores(t)
    matched = _best_pattern(t, scores, L.PATTERN_THRESHOLD)
    by_pattern = matched.where(F.col("pattern").isNotNull()).select(
        "query", F.lit("pattern").alias("source"), F.posexplode(F.split("pattern", "[|]")).alias("i", "c")
    ).select("query", "source", F.col("c").cast("int").alias("candidate"), (F.col("i") + 1).alias("position"))
    classed = scores.withColumn("cls", F.col("candidate") % 3).withColumn("qc", F.struct("query", F.col("candidate") % 3))
    top = L.top_k(classed, 5, "qc").drop("qc", "rank").where("score > 0.10")
    near = L.prune_classes(top, "cls", 0.15)
    kw = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("candidate"), F.lit(0.0).alias("ord"))
    merged = L.merge_candidates([kw, near.select("query", "candidate", (-F.col("score")).alias("ord"))], F.col("candidate"))
    rest = merged.join(matched.where(F.col("pattern").isNotNull()), "query", "left_anti")
    return by_pattern.unionByName(rest.select("query", F.lit("candidates").alias("source"), "candidate", "position"))


@query("t09_route_turn_v1", f"""
WITH {EMBEDDING_SCORES}, {BASE},
task AS (SELECT query, CAST(unnest(string_split(p, '|')) AS INTEGER) AS candidate FROM pm WHERE score >= 0.5), tv AS (SELECT * FROM task WHERE (query + candidate) % 3 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM escores),
g AS (SELECT *, lag(score) OVER w AS prev, first_value(score) OVER w AS best FROM ranked WINDOW w AS (PARTITION BY query ORDER BY rank)),
s AS (SELECT *, CASE WHEN prev IS NULL THEN best <= 0 ELSE prev <= 0 OR (prev - score) / prev > 0.75 OR score / best < 0.20 END AS stop FROM g),
m AS (SELECT query, candidate FROM (SELECT *, max(CAST(stop AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) AS stopped FROM s) WHERE stopped = 0 AND (query + candidate) % 3 <> 0)
SELECT query, candidate, 'task' AS tier FROM tv UNION ALL SELECT query, candidate, 'scores' FROM m WHERE query NOT IN (SELECT query FROM tv)
""")
def t09(t):
    scores = embedding_scores(t)
    task = _best_pattern(t, scores, 0.5).where(F.col("pattern").isNotNull())
    funcs = task.select("query", F.explode(F.split("pattern", "[|]")).alias("c")).select("query", F.col("c").cast("int").alias("candidate"))
    available = (F.col("query") + F.col("candidate")) % 3 != 0
    tier1 = funcs.where(available)
    tier2 = L.select_gap(scores, bound=label_count(t)).where(available).join(tier1.select("query").distinct(), "query", "left_anti")
    return tier1.withColumn("tier", F.lit("task")).unionByName(tier2.select("query", "candidate", F.lit("scores").alias("tier")))


@query("t10_turn_context", f"""
WITH RECURSIVE {PATHS}, sc AS (SELECT user_id, event_type, max(value) / 100 AS s FROM events GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS r FROM sc),
rt AS (SELECT user_id, string_agg(event_type || ' (' || printf('%.2f', s) || ')', ', ' ORDER BY r) AS line FROM rk WHERE r <= 5 AND s > 0.10 GROUP BY user_id),
nm AS (SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS names FROM sc GROUP BY user_id)
SELECT user_id, turn, concat_ws(chr(10), 'CWD: /' || {Q.joined('path', '/')}, 'Files: ' || names, 'Routing: ' || line,
  CASE WHEN turn % 2 = 0 AND turn % 10 >= 5 THEN 'Pattern: click → view (' || printf('%.2f', (turn % 10) / 10) || ')' END) AS context FROM walk LEFT JOIN nm USING (user_id) LEFT JOIN rt USING (user_id) WHERE turn > 0
""")
def t10(t):
    best = t.events.groupBy("user_id", "event_type").agg((F.max("value") / 100).alias("s"))
    # At most as many rows per conversation as there are functions.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("down"), F.col("event_type").alias("name"), F.col("s").alias("score"))))
    per_user = best.groupBy("user_id").agg(ranked.alias("scores"), F.array_sort(F.collect_list("event_type")).alias("names"))
    none = F.array().cast("array<string>")
    pattern = F.when(F.col("turn") % 2 == 0, "click|view")
    rows = paths(t).join(per_user, "user_id")
    return rows.select("user_id", "turn", T.turn_context(F.col("path"), F.col("names"), none, F.col("scores"), pattern, (F.col("turn") % 10) / 10).alias("context"))


@query("t11_transitions", f"""
WITH {NUMBERED} SELECT user_id, turn, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY turn) IN ('signup', 'purchase'), false) AND event_type IN ('view', 'click') AS needs_switch FROM ev
""")
def t11(t):
    out = T.transitions(numbered(t), "user_id", ["turn"], F.col("turn"), "event_type", ("signup", "purchase"), ("view", "click"))
    return out.select("user_id", "turn", "needs_switch")
