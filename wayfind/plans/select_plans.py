"""W-*: ranking and selection; K-01..K-05, K-10, K-12, K-13: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.functions import text as X
from wayfind.operators import evaluate as K
from wayfind.operators import features as E
from wayfind.operators import metrics as M
from wayfind.operators import select as L
from wayfind.operators import session as T
from wayfind.operators import similarity as S
from wayfind.operators.scale import Ordered, hold_if_small, micros
from wayfind.plans import sqltext as Q
from wayfind.plans.join_plans import NUMBERED, numbered
from wayfind.plans.registry import query
from wayfind.plans.similarity_plans import (
    EMBEDDING_SCORES, RELEVANCE_SQL, ROUTE_SQL, WORDS_SQL, benchmark_words, centroid_blocks, document_words, embedding_scores,
    relevance_scores, route,
)

RANKED = f"{EMBEDDING_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM escores)"


def label_count(t):
    """Size of the label catalog: no query has more candidates."""
    return centroid_blocks(t).labels


@query("w01_rank", f"WITH {RANKED} SELECT * FROM ranked")
def w01(t):
    return L.rank(embedding_scores(t), label_count(t))


@query("w02_top_k", f"WITH {RANKED} SELECT * FROM ranked WHERE rank <= 3")
def w02(t):
    return L.top_k(embedding_scores(t, 3), 3)


@query("w02_top8_documents", f"WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)} {Q.top_k(8)}")
def w02_docs(t):
    return S.top_k(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id", 8)


@query("w03_narrow", f"""
WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)}, rk AS ({Q.top_k(3)}), ch AS (SELECT query, candidate, rank, false AS is_fallback FROM rk WHERE score > 0.3),
head AS (SELECT doc_id AS candidate, row_number() OVER (ORDER BY doc_id) AS rank FROM documents)
SELECT * FROM ch UNION ALL SELECT item_id, candidate, rank, true FROM benchmark, head WHERE rank <= 3 AND item_id NOT IN (SELECT query FROM ch)
""")
def w03(t):
    scores = S.top_k(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id", 3).drop("rank")
    head = t.documents.select(F.col("doc_id").alias("candidate")).orderBy("candidate").limit(3)
    first = [r["candidate"] for r in head.collect()]
    fallback = t.spark.createDataFrame([(c, i + 1) for i, c in enumerate(first)], "candidate bigint, ord int")
    return L.narrow(scores, t.benchmark.select(F.col("item_id").alias("query")), fallback, 3, 0.3)


@query("w04_gap_selection", f"""
WITH {RANKED}, g AS (SELECT *, lag(score) OVER w AS prev, first_value(score) OVER w AS best FROM ranked WINDOW w AS (PARTITION BY query ORDER BY rank)),
s AS (SELECT *, CASE WHEN prev IS NULL THEN best <= 0 ELSE prev <= 0 OR (prev - score) / prev > 0.75 OR score / best < 0.20 END AS stop FROM g),
r AS (SELECT *, max(CAST(stop AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) AS stopped FROM s)
SELECT query, candidate, score, rank FROM r WHERE stopped = 0
""")
def w04(t):
    return L.select_gap(embedding_scores(t), bound=label_count(t))


@query("w05_prune_classes", f"""
WITH {EMBEDDING_SCORES}, c AS (SELECT *, candidate % 3 AS cls FROM escores), m AS (SELECT query, cls, max(score) AS cm FROM c GROUP BY ALL), b AS (SELECT query, max(cm) AS best FROM m GROUP BY query)
SELECT c.* FROM c JOIN m USING (query, cls) JOIN b USING (query) WHERE cm >= best - CAST(0.15 AS DOUBLE)
""")
def w05(t):
    return L.prune_classes(embedding_scores(t).withColumn("cls", F.col("candidate") % 3), "cls", 0.15)


@query("w06_merge_candidates", """
WITH kw AS (SELECT user_id AS query, 'K.' || event_type AS candidate, min(event_id)::DOUBLE AS ord FROM events WHERE value > 40 GROUP BY ALL),
sc AS (SELECT user_id AS query, 'S.' || event_type AS candidate, -max(value) AS ord FROM events WHERE value > 25 GROUP BY ALL),
al AS (SELECT DISTINCT user_id AS query, 'A.' || event_type AS candidate, length(event_type)::DOUBLE AS ord FROM events),
u AS (SELECT *, 0 AS stage FROM kw UNION ALL SELECT *, 1 FROM sc UNION ALL SELECT *, 2 FROM al),
f AS (SELECT query, split_part(candidate, '.', 2) AS bare, arg_min(candidate, (stage, ord, candidate)) AS candidate, min((stage, ord, candidate)) AS k FROM u GROUP BY ALL)
SELECT query, bare, candidate, k[1] AS stage, row_number() OVER (PARTITION BY query ORDER BY k) AS position FROM f
""")
def w06(t):
    ev = t.events
    name = lambda p: F.concat(F.lit(p), "event_type").alias("candidate")
    q = F.col("user_id").alias("query")
    kw = ev.where("value > 40").groupBy(q, name("K.")).agg(F.min("event_id").alias("ord"))
    sc = ev.where("value > 25").groupBy(q, name("S.")).agg((-F.max("value")).alias("ord"))
    al = ev.groupBy(q, name("A.")).agg(F.length(F.first("event_type")).alias("ord"))
    return L.merge_candidates([kw, sc, al], C.bare_name(F.col("candidate")))


@query("w07_suggest", f"""
WITH {EMBEDDING_SCORES}, d AS (SELECT vec_id AS query, label AS candidate FROM embeddings WHERE vec_id % 3 = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, candidate % 3 ORDER BY score DESC, candidate) AS r FROM escores) WHERE r <= 3),
u AS (SELECT query, candidate, 1.0::DOUBLE AS score, 0 AS stage FROM d UNION ALL SELECT query, candidate, score, 1 FROM b)
SELECT query, candidate, score, CASE WHEN stage = 0 THEN 'action_map' ELSE 'similarity' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY query, candidate ORDER BY stage) AS n FROM u) WHERE n = 1
""")
def w07(t):
    direct = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("candidate"))
    return L.suggest(direct, embedding_scores(t).withColumn("cls", F.col("candidate") % 3), "cls")


@query("w08_top_of_classes", f"""
WITH {EMBEDDING_SCORES}, b AS (SELECT * FROM (SELECT *, candidate % 2 AS cls, row_number() OVER (PARTITION BY query, candidate % 2 ORDER BY score DESC, candidate) AS r FROM escores) WHERE r <= 3)
SELECT query, candidate, score, cls, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM b) WHERE rank <= 5
""")
def w08(t):
    return L.top_of_classes(embedding_scores(t).withColumn("cls", F.col("candidate") % 2), "cls")


@query("w09_match_pattern", f"""
WITH {EMBEDDING_SCORES}, b AS (SELECT query, CASE candidate // 2 WHEN 0 THEN '[]' ELSE 'p' || (candidate // 2) END AS p, max(score) AS score FROM escores GROUP BY ALL)
SELECT query, CASE WHEN score >= 0.45 THEN p END AS pattern, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p) AS r FROM b WHERE p <> '[]') WHERE r = 1
""")
def w09(t):
    return matched_patterns(t)


def matched_patterns(t):
    base = F.floor(F.col("candidate") / 2)
    name = F.when(base == 0, L.EMPTY_PATTERN).otherwise(F.concat(F.lit("p"), base))
    scores = embedding_scores(t).withColumn("name", F.concat(name, F.lit("__v"), "candidate"))
    queries = t.embeddings.select(F.col("vec_id").alias("query"))
    return L.match_pattern(scores, queries, C.unvariant(F.col("name")))


@query("w10_separation", f"""
WITH {RANKED} SELECT query, a.score AS first, b.score AS second, a.score - b.score AS margin, a.score - b.score > 0.01 AS clear
FROM ranked a JOIN ranked b USING (query) WHERE a.rank = 1 AND b.rank = 2
""")
def w10(t):
    return L.separation(embedding_scores(t, 2))


@query("w13_first_distinct", """
WITH d AS (SELECT event_type, lower(trim(props)) AS n, arg_min(trim(props), event_id) AS props, min(event_id) AS f FROM events GROUP BY ALL)
SELECT event_type, props, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f) AS rank FROM d) WHERE rank <= 20
""")
def w13(t):
    return L.first_distinct(t.events, "event_type", "props", "event_id", 20)


def utterances(t):
    conv = t.conversations
    return Ordered(conv, ["conv_id"], ["turn"], F.col("turn")).row_number("pos").result()


@query("w14_history", """
SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations
""")
def w14(t):
    hist = T.history(utterances(t), "conv_id", "pos", F.col("text"))
    return hist.select("conv_id", "turn", F.array_join("recent", "\n").alias("history"))


@query("w14_history_long", f"""
WITH {NUMBERED} SELECT user_id, turn, coalesce(string_agg(event_type, '|') OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM ev
""")
def w14_long(t):
    """Every event of a user is a turn: histories that run over several blocks."""
    hist = T.history(numbered(t), "user_id", "turn", F.col("event_type"), block=16)
    return hist.select("user_id", "turn", F.array_join("recent", "|").alias("history"))


@query("w15_holdout", f"""
WITH {NUMBERED}, a AS (SELECT user_id, turn, 'f' || (turn % 3) AS names FROM ev WHERE event_type = 'signup'),
j AS (SELECT e.user_id, e.turn, e.event_type || ' ' || e.event_id AS q, names FROM ev e LEFT JOIN a USING (user_id, turn)),
l AS (SELECT *, lag(q) OVER w AS prev, lead(names IS NOT NULL) OVER w AS nxt FROM j WINDOW w AS (PARTITION BY user_id ORDER BY turn))
SELECT user_id, turn, CASE WHEN names IS NULL THEN q ELSE 'Added functions: ' || names || coalesce('; open request: ' || prev, '; no open request') END AS text, coalesce(nxt, false) AS is_holdout FROM l
""")
def w15(t):
    ev = numbered(t)
    turns = ev.select("user_id", "turn", F.concat("event_type", F.lit(" "), "event_id").alias("q"))
    added = ev.where("event_type = 'signup'").select("user_id", "turn", F.concat(F.lit("f"), F.col("turn") % 3).alias("names"))
    return T.holdout(turns, added, "user_id", "turn", "q", F.col("turn")).select("user_id", "turn", "text", "is_holdout")


@query("w16_progress", """
SELECT user_id, event_id, row_number() OVER w AS done, round(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 6) AS accuracy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def w16(t):
    ev = t.events.select("user_id", "event_id", "ts", (F.col("value") < 10).cast("bigint").alias("ok"))
    run = Ordered(ev, ["user_id"], ["ts", "event_id"], micros("ts")).row_number("done").running("right", F.col("ok")).result()
    return run.select("user_id", "event_id", "done", F.round(F.col("right") / F.col("done"), 6).alias("accuracy"))


@query("w17_report_list", "SELECT props, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 10")
def w17(t):
    return M.top_counts(t.events, "props", 10)


# ---- evaluation ----------------------------------------------------------

FLAG_SQL = f"""
WITH {WORDS_SQL}, {Q.all_scores(E.MEMORY)}, top AS ({Q.top_k(3)}),
ok AS (SELECT query, bool_or(contains({Q.strip("regexp_replace(lower(d.text), '[^a-z0-9_" + Q.SPACE + "]', '', 'g')")}, {Q.strip("regexp_replace(lower(b.text), '[^a-z0-9_" + Q.SPACE + "]', '', 'g')")})) AS contained, max(score) AS best
  FROM top JOIN documents d ON d.doc_id = candidate JOIN benchmark b ON b.item_id = query GROUP BY query)
SELECT CASE WHEN best >= 0.5 THEN 'high' WHEN best >= 0.3 THEN 'middle' ELSE 'low' END AS band, count(*) AS total, CAST(sum(CAST(contained AS INTEGER)) AS BIGINT) AS correct,
  sum(CAST(contained AS INTEGER))::DOUBLE / count(*) AS accuracy FROM ok GROUP BY band
"""


@query("k01_flagship_route_benchmark", FLAG_SQL)
def flagship(t):
    """Route each benchmark text to its 3 nearest documents and check containment.

    Ranking works on keys only; the texts join back after the cut.
    """
    top = S.top_k(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id", 3)
    texts = t.documents.select(F.col("doc_id").alias("candidate"), F.col("text").alias("found")).join(hold_if_small(top), "candidate")
    texts = texts.join(t.benchmark.select(F.col("item_id").alias("query"), "text"), "query")
    judged = K.contains_any(texts, "query", F.col("found"), F.col("text"), F.max("score").alias("best"))
    band = F.when(F.col("best") >= 0.5, "high").when(F.col("best") >= 0.3, "middle").otherwise("low")
    return M.accuracy(judged.withColumn("band", band), ["band"], "contained")


TRUTH = "truth AS (SELECT vec_id AS query, label AS expected FROM embeddings)"


def embedding_truth(t):
    return t.embeddings.select(F.col("vec_id").alias("query"), F.col("label").alias("expected"))


@query("k01_eval_single", f"""
WITH {RANKED}, {TRUTH} SELECT expected, count(*) AS total, CAST(sum(CAST(candidate = expected AS INTEGER)) AS BIGINT) AS correct, avg(CAST(candidate = expected AS INTEGER)) AS accuracy
FROM truth JOIN ranked USING (query) WHERE rank = 1 GROUP BY expected
""")
def k01(t):
    return M.accuracy(K.eval_single(embedding_scores(t, 1), embedding_truth(t)), ["expected"])


@query("k02_eval_multi", f"""
WITH {RANKED}, {TRUTH}, g AS (SELECT *, lag(score) OVER w AS prev, first_value(score) OVER w AS best FROM ranked WINDOW w AS (PARTITION BY query ORDER BY rank)),
s AS (SELECT *, CASE WHEN prev IS NULL THEN best <= 0 ELSE prev <= 0 OR (prev - score) / prev > 0.2 OR score / best < 0.8 END AS stop FROM g),
r AS (SELECT query, candidate FROM (SELECT *, max(CAST(stop AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) AS stopped FROM s) WHERE stopped = 0)
SELECT t.query, coalesce((SELECT list(candidate ORDER BY candidate) FROM r WHERE r.query = t.query) = [expected], false) AS correct FROM truth t
""")
def k02(t):
    return K.eval_multi(embedding_scores(t), embedding_truth(t), 0.2, 0.8, label_count(t))


@query("k04_topk_accuracy", f"""
WITH {RANKED}, {TRUTH}, j AS (SELECT t.query, expected, rank FROM truth t LEFT JOIN ranked r ON r.query = t.query AND r.candidate = expected)
SELECT 'all' AS scope, count(*) AS total, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS top3, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS top5 FROM j
UNION ALL SELECT 'without empty', count(*), round(avg(CAST(rank <= 1 AS INTEGER)), 6), round(avg(CAST(rank <= 3 AS INTEGER)), 6), round(avg(CAST(rank <= 5 AS INTEGER)), 6) FROM j WHERE expected <> 0
""")
def k04(t):
    tops = [F.round(f"top{k}", 6).alias(f"top{k}") for k in (1, 3, 5)]
    both = K.topk_scopes(embedding_scores(t, 5), embedding_truth(t), (1, 3, 5), {"all": F.lit(True), "without empty": F.col("expected") != 0})
    return both.select("scope", "total", *tops)


@query("k05_eval_irrelevance", f"""
{RELEVANCE_SQL}, j AS (SELECT score >= 0.02 AS p, quality = 1 AS a FROM best JOIN labels ON query = doc_id)
SELECT count(*) AS total, count(*) FILTER (WHERE p AND a) AS true_positive, count(*) FILTER (WHERE p AND NOT a) AS false_positive, count(*) FILTER (WHERE NOT p AND a) AS false_negative,
 count(*) FILTER (WHERE NOT p AND NOT a) AS true_negative, count(*) FILTER (WHERE p = a)::DOUBLE / count(*) AS accuracy FROM j
""")
def k05(t):
    flagged = S.relevant(relevance_scores(t), 0.02)
    truth = t.labels.select(F.col("doc_id").alias("query"), (F.col("quality") == 1).alias("actual"))
    return K.confusion(flagged, truth, "query", "is_relevant", "actual")


@query("k10_pattern_hit_rate", f"""
WITH {EMBEDDING_SCORES}, b AS (SELECT query, max(score) AS s FROM escores WHERE candidate >= 2 GROUP BY query)
SELECT count(*) AS turns, count(*) FILTER (WHERE s >= 0.45) AS hits, CAST(0 AS BIGINT) AS empty_hits, count(*) FILTER (WHERE s >= 0.45)::DOUBLE / count(*) AS hit_rate FROM b
""")
def k10(t):
    return K.pattern_hit_rate(matched_patterns(t))


@query("k12_rule_coverage", """
SELECT 'no function' AS gap, n_regionkey AS action, n_nationkey AS func FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0)
UNION ALL SELECT DISTINCT 'no action', CAST(s_nationkey % 7 AS INTEGER), s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0 AND s_nationkey % 7 NOT IN (SELECT n_regionkey FROM nation)
""")
def k12(t):
    forward = t.nation.select(F.col("n_regionkey").alias("action"), F.col("n_nationkey").alias("func"))
    backward = t.supplier.where("s_suppkey % 5 <> 0").select((F.col("s_nationkey") % 7).alias("action"), F.col("s_nationkey").alias("func")).distinct()
    return K.rule_coverage(forward, backward, "action", "func")


@query("k13_usage_delta", "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS delta FROM events")
def k13(t):
    ev = t.events.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    totals = Ordered(ev, ["user_id"], ["ts", "event_id"], micros("ts")).running("total", F.col("k")).result()
    return K.usage_delta(totals, "user_id", ["ts", "event_id"], micros("ts"), "total").select("event_id", "user_id", "delta")
