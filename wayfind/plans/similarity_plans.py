"""E-*: encoding and similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wayfind.functions import schema as SC
from wayfind.functions import text as X
from wayfind.functions import vectors as V
from wayfind.functions import words as W
from wayfind.operators import features as E
from wayfind.operators import levels as H
from wayfind.operators import nearest as N
from wayfind.operators import rules as R
from wayfind.operators import similarity as S
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query
from wayfind.plans.rule_plans import PART_WORDS, RULES, part_rules, word_rules
from wayfind.plans.text_plans import PARAM_TOKENS_SQL, PARAM_TOKENS_UNTYPED_SQL, part_properties


def part_catalog(t):
    """Parts as catalog functions: ``ECONOMY.small_ring`` with a description and a schema."""
    return t.part.select(
        "p_partkey",
        F.concat("p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
        F.concat(F.lit("Belongs to parts. Tool description: Returns the "), "p_name", F.lit(" of "), "p_brand",
                 F.lit(" with size "), "p_size").alias("description"),
        part_properties().alias("props"),
        F.col("p_type").alias("cls"),
    )


_DESC = "('Belongs to parts. Tool description: Returns the ' || p_name || ' of ' || p_brand || ' with size ' || p_size)"
_LAST = Q.split_name("replace(p_name, ' ', '_')")
_FULL = Q.split_name("p_type || '.' || replace(p_name, ' ', '_')")
_CLEAN = Q.clean_description(_DESC)


def part_queries(t):
    """Distinct requests for a kind of part."""
    text = F.concat(F.lit("please find the "), "p_name", F.lit(" in "), "p_type")
    return t.part.select(text.alias("text")).distinct().withColumn("key", F.col("text"))


PART_QUERIES = "pq AS (SELECT DISTINCT 'please find the ' || p_name || ' in ' || p_type AS text FROM part)"

FUNCTIONS_SQL = f"""d AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, {_LAST} AS last, {_FULL} AS full_name, {_CLEAN} AS descr FROM part),
aw AS (SELECT *, {Q.intent_words("last || ' ' || full_name || ' ' || descr")} AS a, {Q.intent_words("last || ' ' || descr")} AS g FROM d),
cat AS (SELECT p_partkey AS key, {Q.action('a', 'verbs')} AS action, {Q.first_word('g', 'nouns')} AS target,
  {Q.bag_items(Q.tokenize('last'))} AS function_name, {Q.bag_items(Q.tokenize('descr'))} AS description, {Q.bag_items(PARAM_TOKENS_SQL)} AS parameters FROM aw)"""


def _bags(roles):
    """Bags as sorted strings: the set is what counts."""
    return [F.array_join(F.array_sort(r), " ").alias(r) for r in roles]


def _bags_sql(roles):
    return ", ".join(f"array_to_string(list_sort({r}), ' ') AS {r}" for r in roles)


_G = ["function_name", "description", "parameters"]


@query("e01_encode_functions", f"WITH {PART_WORDS}, {FUNCTIONS_SQL} SELECT key, action, target, {_bags_sql(_G)} FROM cat")
def e01(t):
    enc = E.encode_functions(part_catalog(t), "p_partkey", part_rules(t, 0, 0), part_rules(t, 1, 2))
    return enc.select(F.col("p_partkey").alias("key"), "action", "target", *_bags(_G))


@query("e01_long_features", f"""WITH {PART_WORDS}, {FUNCTIONS_SQL}
SELECT key, 'action' AS role, action AS token FROM cat UNION ALL SELECT key, 'target', target FROM cat
UNION ALL SELECT key, 'function_name', unnest(function_name) FROM cat UNION ALL SELECT key, 'description', unnest(description) FROM cat
UNION ALL SELECT key, 'parameters', unnest(parameters) FROM cat""")
def e01_long(t):
    enc = E.encode_functions(part_catalog(t), "p_partkey", part_rules(t, 0, 0), part_rules(t, 1, 2))
    return E.long_features(enc.withColumnRenamed("p_partkey", "key"), "key", E.GENERIC)


_PH = "(SELECT r.canonical FROM rules r WHERE length(r.pattern) > 5 AND contains(lower(text), r.pattern) ORDER BY length(r.pattern) DESC, r.ordinal LIMIT 1)"
_PH_ALL = "(SELECT list(canonical) FROM rules r WHERE length(r.pattern) > 5 AND contains(lower(text), r.pattern))"
_QPARAMS = "list_concat(list_concat(list_concat(regexp_extract_all(text, '\"([^\"]*)\"', 1), regexp_extract_all(text, '''([^'']*)''', 1)), regexp_extract_all(text, '\\b\\d+\\.?\\d*\\b')), tk)"
_WHAT = f"list_filter(tk, lambda w: not list_contains({Q.words_list(W.HOW_WORDS)}, w))"

QUERY_ROLES_SQL = f"""bt AS (SELECT item_id, text, {Q.tokenize('text')} AS tk, {Q.intent_words('text')} AS iw FROM benchmark),
q AS (SELECT item_id AS key, {Q.action('iw', 'rules', _PH)} AS action, {Q.first_word('iw', 'rules')} AS target,
  {Q.bag_items(f"list_concat(tk, coalesce({_PH_ALL}, []))")} AS function_name,
  {Q.bag_items(f"CASE WHEN len({_WHAT}) > 0 THEN {_WHAT} ELSE tk END")} AS description,
  {Q.bag_items(_QPARAMS)} AS parameters FROM bt)"""


def benchmark_roles(t):
    rules = word_rules(t)
    return E.encode_queries(t.benchmark, "item_id", "text", rules, rules, rules.where(F.length("pattern") > 5))


@query("e02_encode_queries", f"WITH {RULES}, {QUERY_ROLES_SQL} SELECT key, action, target, {_bags_sql(_G)} FROM q")
def e02(t):
    return benchmark_roles(t).select(F.col("item_id").alias("key"), "action", "target", *_bags(_G))


@query("e03_encode_per_class", f"""
WITH i AS (SELECT p_type AS cls, replace(p_name, ' ', '_') AS func, min(p_brand) AS action, max(p_brand) AS target FROM part GROUP BY ALL HAVING min(p_size) % 2 = 0),
df AS (SELECT DISTINCT p_type AS cls, 'd' || p_type AS default_target FROM part WHERE p_type <> 'PROMO'),
d AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, p_type AS cls, replace(p_name, ' ', '_') AS func, {Q.tokenize(_CLEAN)} AS dt, {Q.tokenize(_LAST)} AS nt FROM part)
SELECT p_partkey AS key, cls, coalesce(action, 'none') AS action, coalesce(target, default_target, 'none') AS target,
 {_bags_sql(['description', 'parameters'])}
FROM (SELECT d.*, i.action, i.target, df.default_target, {Q.bag_items('list_concat(dt, nt)')} AS description, {Q.bag_items(PARAM_TOKENS_UNTYPED_SQL)} AS parameters
  FROM d LEFT JOIN i USING (cls, func) LEFT JOIN df USING (cls))
""")
def e03(t):
    intents = t.part.groupBy(F.col("p_type").alias("cls"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("func")).agg(
        F.min("p_brand").alias("action"), F.max("p_brand").alias("target"), F.min("p_size").alias("s")
    ).where("s % 2 = 0").drop("s")
    defaults = t.part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("cls")).distinct().withColumn(
        "default_target", F.concat(F.lit("d"), "cls")
    )
    enc = E.encode_class_functions(part_catalog(t), "p_partkey", intents, defaults)
    return enc.select(F.col("p_partkey").alias("key"), "cls", "action", "target", *_bags(["description", "parameters"]))


NOUNS = ("ring", "bolt", "gear", "widget", "brand")
_U = ["description", "keywords", "param_names", "param_types", "entities"]


@query("e05_encode_unified", f"""
WITH d AS (SELECT p_partkey, p_type, p_brand, p_size, p_name, replace(p_name, ' ', '_') AS bare, {_LAST} AS last, {_CLEAN} AS descr FROM part)
SELECT p_partkey AS key, bare AS action, coalesce(list_filter({Q.words_list(NOUNS)}, lambda n: contains(lower(descr), n) or contains(lower(bare), n))[1], 'none') AS target, {_bags_sql(_U)} FROM (
 SELECT *, {Q.bag_items(f"list_concat({Q.tokenize('descr')}, string_split(last, ' '))")} AS description,
  {Q.bag_items(f"list_concat({Q.tokenize('last')}, {Q.tokenize('descr')})")} AS keywords,
  ['part', 'key', 'brand', 'name', 'size', 'a'] AS param_names, ['integer', 'string', 'float'] AS param_types,
  {Q.bag_items("list_concat(list_concat(" + Q.tokenize("'The key of the ' || p_name") + ", [lower(p_brand), lower(p_type), 'any-brand']), list_concat(" + Q.tokenize("'Value of size for the ' || p_type || ' ' || p_name || ' part in a box'") + ", [CAST(p_size AS VARCHAR)]))")} AS entities FROM d)
""")
def e05(t):
    enc = E.encode_unified(part_catalog(t), "p_partkey", NOUNS)
    return enc.select(F.col("p_partkey").alias("key"), "action", "target", *_bags(_U))


# ---- vectors -------------------------------------------------------------

DIM = 128


def _bit(hexes: str, i: str) -> str:
    digit = f"ascii(substring({hexes}, CAST({i} // 4 + 1 AS BIGINT), 1))"
    value = f"({digit} - CASE WHEN {digit} > 96 THEN 87 ELSE 48 END)"
    return f"(((CAST({value} AS INTEGER) >> CAST(3 - {i} % 4 AS INTEGER)) & 1) * 2 - 1)"


@query("e07_symbol", f"""
SELECT p_name AS token, array_to_string(list_transform(range({DIM}), lambda i: {_bit("h", "i")}), ',') AS vec
FROM (SELECT DISTINCT p_name, md5('42:' || p_name || ':0') AS h FROM part)
""")
def e07(t):
    return t.part.select(F.col("p_name").alias("token")).distinct().select(
        "token", F.array_join(V.symbol(42, F.col("token"), DIM).cast("array<string>"), ",").alias("vec")
    )


def bundle_sql(tokens: str, seed: int = 42) -> str:
    hashes = f"list_transform({tokens}, lambda w: md5('{seed}:' || w || ':0'))"
    return f"list_transform(range({DIM}), lambda i: sign(list_sum(list_transform({hashes}, lambda h: {_bit('h', 'i')}))))"


@query("e08_bundle", f"""
WITH x AS (SELECT item_id, {Q.bag_items(Q.tokenize('text'))} AS t FROM benchmark),
h AS (SELECT item_id, md5('42:' || unnest(t) || ':0') AS h FROM x),
b AS (SELECT item_id, i, CAST(sign(sum({_bit('h', 'i')})) AS INTEGER) AS s FROM h, (SELECT unnest(range({DIM})) AS i) GROUP BY item_id, i)
SELECT item_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS vec FROM b GROUP BY item_id
""")
def e08(t):
    bags = t.benchmark.select("item_id", X.bag_items(X.tokenize(F.col("text"))).alias("t"))
    return bags.select("item_id", F.array_join(V.bundle(42, F.col("t"), DIM).cast("array<string>"), ",").alias("vec"))


@query("e09_bind", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS bound_sum,
 round(CAST(embedding[1] AS DOUBLE) * CAST(embedding[64] AS DOUBLE), 9) AS first FROM embeddings
""")
def e09(t):
    e = F.col("embedding").cast("array<double>")
    both = t.embeddings.select("vec_id", V.bind(e, e).alias("b"), V.bind(e, F.reverse(e)).alias("r"))
    total = F.aggregate("b", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return both.select("vec_id", F.round(total, 6).alias("bound_sum"), F.round(F.get("r", F.lit(0)), 9).alias("first"))


def centroids(t):
    return N.centroids(t.embeddings, "label", "embedding")


CENTROIDS = "cen AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
COSINE = "list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


def centroid_blocks(t) -> N.CentroidBlocks:
    """The label centroids in blocks, made once per query."""
    return t.once("centroid_blocks", lambda: N.CentroidBlocks(centroids(t), "label"))


def embedding_scores(t, k=None):
    """Cosine of vectors to label centroids, all or each vector's best ``k`` per block: ``(query, candidate, score)``."""
    return centroid_blocks(t).scores(t.embeddings, "vec_id", "embedding", k)


EMBEDDING_SCORES = f"""{CENTROIDS}, escores AS (SELECT query, candidate, round({COSINE}, 9) AS score
 FROM (SELECT vec_id AS query, cen.label AS candidate, embedding AS a, centroid AS b FROM embeddings CROSS JOIN cen))"""


@query("e10_cosine", f"WITH {EMBEDDING_SCORES} SELECT query, candidate, round(score, 6) AS score FROM escores")
def e10(t):
    return embedding_scores(t).select("query", "candidate", F.round("score", 6).alias("score"))


@query("g19_centroid", f"WITH {CENTROIDS} SELECT label, generate_subscripts(centroid, 1) - 1 AS dim, round(unnest(centroid), 6) AS mean FROM cen")
def g19(t):
    return centroids(t).select("label", F.posexplode("centroid").alias("dim", "m")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), F.round("m", 6).alias("mean"))


@query("e11_category_similarity", f"""
WITH {PART_WORDS} SELECT p_partkey, CASE WHEN action = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sim FROM acts
""")
def e11(t):
    from wayfind.plans.rule_plans import part_intent

    return part_intent(t).select("p_partkey", (F.col("action") == F.col("target")).cast("double").alias("sim"))


# ---- layered scores ------------------------------------------------------

def document_words(t, tokens=X.tokenize):
    return t.documents.select("doc_id", X.bag_items(tokens(F.col("text"))).alias("words"))


def benchmark_words(t, tokens=X.tokenize):
    return t.benchmark.select("item_id", X.bag_items(tokens(F.col("text"))).alias("words"))


WORDS_SQL = f"""q AS (SELECT item_id AS key, {Q.bag_items(Q.tokenize('text'))} AS words FROM benchmark),
c AS (SELECT doc_id AS key, {Q.bag_items(Q.tokenize('text'))} AS words FROM documents)"""


@query("e12_bag_similarity", f"WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)} SELECT * FROM scores WHERE score > 0")
def e12(t):
    return S.score_overlapping(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id")


@query("e12_similar_pairs", f"WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)} SELECT * FROM scores WHERE score >= 0.15")
def e12_pairs(t):
    """The pairs worth having: what scores less never leaves its row."""
    return S.pairs_above(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id", 0.15)


DOC_FUNCTIONS_SQL = f"""dd AS (SELECT doc_id, {Q.split_name("source || '.' || lang")} AS full_name, {Q.split_name('lang')} AS last, {Q.clean_description('text')} AS descr FROM documents),
dw AS (SELECT *, {Q.intent_words("last || ' ' || full_name || ' ' || descr")} AS a, {Q.intent_words("last || ' ' || descr")} AS g FROM dd),
c AS (SELECT doc_id AS key, {Q.action('a', 'rules')} AS action, {Q.first_word('g', 'rules')} AS target,
  {Q.bag_items(Q.tokenize('last'))} AS function_name, {Q.bag_items(Q.tokenize('descr'))} AS description, ['none'] AS parameters FROM dw)"""


def document_functions(t):
    return t.documents.select(
        "doc_id", F.concat("source", F.lit("."), "lang").alias("name"), F.col("text").alias("description"),
        F.create_map().cast(SC.PROPERTIES).alias("props"),
    )


def document_roles(t):
    rules = word_rules(t)
    return E.encode_functions(document_functions(t), "doc_id", rules, rules)


ROUTE_SQL = f"WITH {RULES}, {QUERY_ROLES_SQL}, {DOC_FUNCTIONS_SQL}, {Q.all_scores(E.GENERIC)}"


def route(t, k):
    return S.top_k(benchmark_roles(t), document_roles(t), E.GENERIC, "item_id", "doc_id", k)


@query("e13_layered_top5", f"{ROUTE_SQL} {Q.top_k(5)}")
def e13(t):
    return route(t, 5)


@query("j08_similar_pairs", f"{ROUTE_SQL} SELECT query, candidate, score FROM scores WHERE score >= 0.35")
def j08_pairs(t):
    """Similarity join on all roles: pairs of a text and a document above a score."""
    return S.pairs_above(benchmark_roles(t), document_roles(t), E.GENERIC, "item_id", "doc_id", 0.35)


def _levels(parts, prefix):
    """Role vectors bundled upwards: roles -> segment = layer -> cortex."""
    names = ["function_name", "description", "parameters"]
    for n in names:
        parts = parts.withColumn(f"{prefix}_{n}", V.bundle(42, F.col(n), DIM))
    up = lambda *cols: V.majority(reduce(V.add, [F.col(c) for c in cols]))
    parts = parts.withColumn(f"{prefix}_sem", up(f"{prefix}_description", f"{prefix}_parameters"))
    return parts.withColumn(f"{prefix}_cortex", up(f"{prefix}_function_name", f"{prefix}_sem"))


def _cos_sql(a, b):
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / nullif(sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * x))), 0), 0)"


def _up_sql(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda p: sign(p[1] + p[2]))"


@query("e14_hierarchical", f"""
WITH s AS (SELECT DISTINCT p_name, p_type, p_brand FROM part),
f AS (SELECT p_name, p_type, p_brand, {bundle_sql("string_split(lower(p_name), ' ')")} AS cn, {bundle_sql("list_distinct([lower(p_type), lower(p_brand)])")} AS cd, {bundle_sql("[lower(p_brand)]")} AS cp,
  {bundle_sql("string_split(lower(p_name || ' ' || p_type), ' ')")} AS qn, {bundle_sql("string_split(lower(p_type || ' ' || p_name), ' ')")} AS qd, {bundle_sql("[lower(p_type)]")} AS qp FROM s),
g AS (SELECT *, {_up_sql('cd', 'cp')} AS cs, {_up_sql('qd', 'qp')} AS qs FROM f),
h AS (SELECT *, {_up_sql('cn', 'cs')} AS cc, {_up_sql('qn', 'qs')} AS qc FROM g)
SELECT p_name, p_type, p_brand, round({Q.double(0.05)} * {_cos_sql('qc', 'cc')} + {Q.double(0.10)} * ({_cos_sql('qn', 'cn')} + {_cos_sql('qs', 'cs')}) / 2
  + {Q.double(0.25)} * ({_cos_sql('qn', 'cn')} + {_cos_sql('qs', 'cs')}) / 2 + {Q.double(0.60)} * ({_cos_sql('qn', 'cn')} + {_cos_sql('qd', 'cd')} + {_cos_sql('qp', 'cp')}) / 3, 6) AS score FROM h
""")
def e14(t):
    # Equal rows have equal vectors: encode every distinct row once.
    rows = t.part.select("p_name", "p_type", "p_brand").distinct()
    words = lambda *cols: X.split_space(F.lower(F.concat_ws(" ", *cols)))
    rows = rows.withColumn("function_name", words("p_name")).withColumn("description", F.array_distinct(words("p_type", "p_brand"))).withColumn("parameters", words("p_brand"))
    rows = _levels(rows, "c")
    rows = rows.withColumn("function_name", words("p_name", "p_type")).withColumn("description", words("p_type", "p_name")).withColumn("parameters", words("p_type"))
    rows = _levels(rows, "q")
    cos = lambda n: V.cosine(F.col(f"q_{n}"), F.col(f"c_{n}"))
    segments = [cos("function_name"), cos("sem")]
    score = S.hierarchical([cos("function_name"), cos("description"), cos("parameters")], segments, segments, cos("cortex"))
    return rows.select("p_name", "p_type", "p_brand", F.round(score, 6).alias("score"))


E14_PARTS = f"""s AS (SELECT DISTINCT p_name, p_type, p_brand FROM part),
c AS (SELECT p_name, p_type, p_brand, {bundle_sql("string_split(lower(p_name), ' ')")} AS n, {bundle_sql("list_distinct([lower(p_type), lower(p_brand)])")} AS d, {bundle_sql("[lower(p_brand)]")} AS p FROM s),
cl AS (SELECT *, {_up_sql('d', 'p')} AS s FROM c), cc AS (SELECT *, {_up_sql('n', 's')} AS x FROM cl),
r AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_size <= 2),
q AS (SELECT p_name || '/' || p_type AS query, {bundle_sql("string_split(lower(p_name || ' ' || p_type), ' ')")} AS n, {bundle_sql("string_split(lower(p_type || ' ' || p_name), ' ')")} AS d, {bundle_sql("[lower(p_type)]")} AS p FROM r),
ql AS (SELECT *, {_up_sql('d', 'p')} AS s FROM q), qc AS (SELECT *, {_up_sql('n', 's')} AS x FROM ql),
pairs AS (SELECT query, p_name, p_type, p_brand, round({Q.double(0.05)} * {_cos_sql('qc.x', 'cc.x')} + {Q.double(0.10)} * ({_cos_sql('qc.n', 'cc.n')} + {_cos_sql('qc.s', 'cc.s')}) / 2
  + {Q.double(0.25)} * ({_cos_sql('qc.n', 'cc.n')} + {_cos_sql('qc.s', 'cc.s')}) / 2 + {Q.double(0.60)} * ({_cos_sql('qc.n', 'cc.n')} + {_cos_sql('qc.d', 'cc.d')} + {_cos_sql('qc.p', 'cc.p')}) / 3, 6) AS score FROM qc CROSS JOIN cc)"""

LEVELS = H.Shape({"name": ("function_name",), "meaning": ("description", "parameters")}, {"name": ("name",), "meaning": ("meaning",)})


@query("e14_ranking", f"""
WITH {E14_PARTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p_name, p_type, p_brand) AS rank FROM pairs) WHERE rank <= 5
""")
def e14_ranking(t):
    """Requests for small parts against every kind of part, all pairs weighed by the four levels."""
    words = lambda *cols: X.split_space(F.lower(F.concat_ws(" ", *cols)))
    kinds = t.part.select("p_name", "p_type", "p_brand").distinct()
    catalog = kinds.withColumns({"function_name": words("p_name"), "description": F.array_distinct(words("p_type", "p_brand")), "parameters": words("p_brand")})
    asked = t.part.where("p_size <= 2").select("p_name", "p_type").distinct()
    asked = asked.select(
        F.concat_ws("/", "p_name", "p_type").alias("query"), words("p_name", "p_type").alias("function_name"),
        words("p_type", "p_name").alias("description"), words("p_type").alias("parameters"),
    )
    return H.rank_levels(H.bundled(asked, LEVELS, 42, DIM), H.bundled(catalog, LEVELS, 42, DIM), LEVELS, "query", ["p_name", "p_type", "p_brand"], 5, DIM)


# ---- relevance -----------------------------------------------------------

_GEN = W.STOP_WORDS + W.GENERIC_WORDS
RELEVANCE_SQL = f"""WITH q AS (SELECT item_id AS key, {Q.bag_items(Q.tokenize('text', _GEN))} AS param_tokens, {Q.bag_items(Q.tokenize('text', _GEN))} AS name_tokens, {Q.bag_items(Q.tokenize('text', _GEN))} AS desc_tokens FROM benchmark),
c AS (SELECT doc_id AS key, ['none'] AS param_tokens, {Q.bag_items(Q.tokenize(Q.split_name("source || '.' || lang"), _GEN))} AS name_tokens,
  {Q.bag_items(f"{Q.tokenize('text', _GEN)}")} AS desc_tokens FROM documents),
{Q.all_scores(E.RELEVANCE)},
best AS (SELECT query, greatest(max(score), 0.0::DOUBLE) AS score FROM scores GROUP BY query)"""


def relevance_scores(t):
    catalog = E.encode_relevance_functions(document_functions(t), "doc_id")
    queries = E.encode_relevance_queries(t.benchmark, "item_id", "text")
    return S.best_score(queries, catalog, E.RELEVANCE, "item_id", "doc_id")


@query("e15_relevance_score", f"{RELEVANCE_SQL} SELECT query, score FROM best")
def e15(t):
    return relevance_scores(t)


SIDECAR_SQL = f"""WITH {PART_WORDS}, {PART_QUERIES},
q AS (SELECT text AS key, {Q.bag_items(Q.tokenize('text'))} AS name_tokens, {Q.first_word(Q.intent_words('text'), 'nouns')} AS target, {Q.bag_items(Q.tokenize('text', W.STOP_WORDS + W.FILLER_WORDS))} AS description_nouns FROM pq),
cd AS (SELECT p_partkey, {_FULL} AS full_name, {_DESC} AS descr FROM part),
c AS (SELECT p_partkey AS key, {Q.bag_items(Q.tokenize('full_name'))} AS name_tokens, {Q.first_word(Q.intent_words("full_name || ' ' || descr"), 'nouns')} AS target,
  {Q.bag_items(Q.tokenize('descr', W.STOP_WORDS + W.FILLER_WORDS))} AS description_nouns FROM cd),
{Q.all_scores(E.SIDECAR)},
best AS (SELECT query, greatest(max(score), 0.0::DOUBLE) AS score FROM scores GROUP BY query)"""


def sidecar_scores(t):
    nouns = part_rules(t, 1, 2)
    q = R.word_hits(part_queries(t), "key", X.intent_words(F.col("text")), nouns, "n")
    q = E.encode_sidecar(q, "key", F.col("text"), F.col("text"), R.first_word(F.col("n")))
    words = F.concat_ws(" ", X.split_name(F.col("name")), F.col("description"))
    c = R.word_hits(part_catalog(t), "p_partkey", X.intent_words(words), nouns, "n")
    c = E.encode_sidecar(c, "p_partkey", X.split_name(F.col("name")), F.col("description"), R.first_word(F.col("n")))
    return S.best_score(q, c, E.SIDECAR, "key", "p_partkey", many_copies=True)


@query("e16_sidecar_score", f"{SIDECAR_SQL} SELECT query, score FROM best")
def e16(t):
    return sidecar_scores(t)


@query("e17_blended_relevance", f"""{ROUTE_SQL},
main AS (SELECT query, max(score) AS main FROM scores GROUP BY query),
side AS (WITH {RELEVANCE_SQL[5:]} SELECT query, score AS side FROM best)
SELECT query, main, side, round({Q.double(0.4)} * main + {Q.double(0.6)} * side, 9) AS blend, round({Q.double(0.4)} * main + {Q.double(0.6)} * side, 9) >= 0.18 AS is_relevant FROM main JOIN side USING (query)
""")
def e17(t):
    main = S.best_score(benchmark_roles(t), document_roles(t), E.GENERIC, "item_id", "doc_id")
    return S.blended(main, relevance_scores(t))


@query("e18_relevant", f"{RELEVANCE_SQL} SELECT query, score, score >= 0.20 AS is_relevant, (score < 0.20) OR score < 0.22 AS rejected FROM best")
def e18(t):
    flagged = S.relevant(relevance_scores(t))
    return flagged.withColumn("rejected", S.irrelevant_or_unsure(~F.col("is_relevant"), F.col("score"), 0.22))
