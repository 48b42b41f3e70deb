"""G-*: evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.functions import text as X
from wayfind.operators import metrics as M
from wayfind.operators import select as L
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query
from wayfind.plans.similarity_plans import EMBEDDING_SCORES, embedding_scores


@query("g01_accuracy", """
SELECT source, count(*) AS total, CAST(coalesce(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct,
 sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def g01(t):
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return M.accuracy(joined.withColumn("correct", F.coalesce(F.col("quality") == 1, F.lit(False))), ["source"])


def usage_rows(t):
    """Line items as usage records of a category (the order's status) and a tier."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("category"), "l_shipdate", "l_orderkey", "l_linenumber",
        (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        F.col("l_partkey").alias("output_tokens"),
        F.col("l_suppkey").alias("cache_write_tokens"),
        (F.col("l_quantity").cast("bigint") * (F.col("l_linenumber") + 20)).alias("cache_read_tokens"),
        F.col("l_linenumber").cast("bigint").alias("api_calls"),
    )


USAGE = """u AS (SELECT l_returnflag AS tier, l_linestatus AS category, CAST(l_quantity * 100 AS BIGINT) AS i, l_partkey AS o, l_suppkey AS w,
  CAST(l_quantity AS BIGINT) * (l_linenumber + 20) AS r, l_linenumber AS a FROM lineitem),
s AS (SELECT tier, category, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(w) AS BIGINT) AS cache_write_tokens,
  CAST(sum(r) AS BIGINT) AS cache_read_tokens, CAST(sum(a) AS BIGINT) AS api_calls, CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens FROM u GROUP BY ALL)"""

PRICES = (("A", 3.0, 15.0, 3.75, 0.3), ("N", 1.0, 5.0, 1.25, 0.1), ("R", 5.0, 25.0, 6.25, 0.5))
PRICE_COLUMNS = "tier string, p_in double, p_out double, p_cache_write double, p_cache_read double"
PRICES_SQL = f"p(tier, p_in, p_out, p_cw, p_cr) AS (VALUES {', '.join(str(p) for p in PRICES)})"


@query("g02_usage", f"WITH {USAGE} SELECT * FROM s")
def g02(t):
    return M.usage(usage_rows(t), ["tier", "category"])


@query("g03_cost", f"""
WITH {USAGE}, {PRICES_SQL}
SELECT tier, category, round(greatest(input_tokens - cache_read_tokens, 0) / 1e6 * CAST(p_in AS DOUBLE) + cache_write_tokens / 1e6 * CAST(p_cw AS DOUBLE)
 + cache_read_tokens / 1e6 * CAST(p_cr AS DOUBLE) + output_tokens / 1e6 * CAST(p_out AS DOUBLE), 6) AS cost FROM s JOIN p USING (tier)
""")
def g03(t):
    prices = t.spark.createDataFrame(list(PRICES), PRICE_COLUMNS)
    return M.cost(M.usage(usage_rows(t), ["tier", "category"]), prices).select("tier", "category", F.round("cost", 6).alias("cost"))


@query("g04_latency", """
SELECT user_id, event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY ALL
UNION ALL SELECT -1, event_type, round(avg(value), 6), round(coalesce(stddev_samp(value), 0), 6), quantile_disc(value, 0.95) FROM events GROUP BY event_type
""")
def g04(t):
    rounded = [F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "p95"]
    fine = M.latency(t.events, ["user_id", "event_type"], "value").select("user_id", "event_type", *rounded)
    coarse = M.latency(t.events, ["event_type"], "value").select(F.lit(-1).cast("bigint").alias("user_id"), "event_type", *rounded)
    return fine.unionByName(coarse)


def category_results(t):
    """Events as entry results: the category is the event type, large values are wrong."""
    section = (
        F.when(F.col("event_type").isin("click", "view"), "agentic").when(F.col("event_type") == "error", "live")
        .when(F.col("event_type") == "signup", "non_live").otherwise("multi_turn")
    )
    return t.events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("category"), section.alias("section"),
        F.col("event_type").alias("sub_section"), (F.col("value") < 10).alias("correct"), "value",
    )


CATEGORIES = """res AS (SELECT event_id, ts, user_id, event_type AS category, CASE WHEN event_type IN ('click', 'view') THEN 'agentic' WHEN event_type = 'error' THEN 'live'
  WHEN event_type = 'signup' THEN 'non_live' ELSE 'multi_turn' END AS section, value < 10 AS correct, value FROM events),
cat AS (SELECT section, category, count(*) AS n, avg(CAST(correct AS INTEGER)) AS acc FROM res GROUP BY ALL)"""
WEIGHTS_SQL = f"w(section, weight) AS (VALUES {', '.join(f'({k!r}, CAST({v} AS DOUBLE))' for k, v in M.SECTION_WEIGHTS.items())})"


@query("g05_composite", f"""
WITH {CATEGORIES}, {WEIGHTS_SQL}, sec AS (SELECT section, avg(acc) AS score FROM cat GROUP BY section)
SELECT round(sum(score * weight) / sum(weight), 6) AS overall, round(sum(weight), 6) AS weight_covered FROM sec JOIN w USING (section)
""")
def g05(t):
    weights = t.spark.createDataFrame(list(M.SECTION_WEIGHTS.items()), "section string, weight double")
    cats = M.accuracy(category_results(t), ["section", "sub_section", "category"])
    return M.composite(cats, weights).select(F.round("overall", 6).alias("overall"), F.round("weight_covered", 6).alias("weight_covered"))


@query("g06_weighted_mean", f"WITH {CATEGORIES} SELECT section, round(sum(acc * n) / sum(n), 6) AS mean FROM cat GROUP BY section")
def g06(t):
    cats = M.accuracy(category_results(t), ["section", "category"])
    return M.weighted_mean(cats, ["section"], "accuracy", "total").select("section", F.round("mean", 6).alias("mean"))


@query("g07_report", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n,
 CAST(sum(l_linenumber) AS BIGINT) AS calls, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def g07(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("calls"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@query("g08_best_variant", f"WITH {EMBEDDING_SCORES} SELECT query, 'f' || (candidate % 4) AS base, max(score) AS score FROM escores GROUP BY ALL")
def g08(t):
    named = embedding_scores(t).withColumn("name", F.concat(F.lit("f"), F.col("candidate") % 4, F.lit("__v"), "candidate"))
    return M.best_variant(named, "query", C.unvariant(F.col("name")), "score")


@query("g09_function_stats", """
SELECT event_type, count(*) AS total, count(DISTINCT lower(trim(props))) AS distinct_queries FROM events GROUP BY event_type ORDER BY total DESC, event_type LIMIT 20
""")
def g09(t):
    return M.function_stats(t.events, "event_type", "props").orderBy(F.desc("total"), "event_type").limit(20)


SHARED = f"""tk AS (SELECT source, doc_id, {Q.tokenize('text')} AS t FROM documents),
shared AS (SELECT source, lang, token FROM (SELECT source, lang, doc_id, unnest(list_distinct(t)) AS token FROM tk JOIN documents USING (source, doc_id))
  JOIN (SELECT source, lang, count(*) AS size FROM documents GROUP BY ALL) USING (source, lang) GROUP BY source, lang, token, size HAVING count(*) = size AND size > 1)"""


def document_class(t):
    return t.documents.select("doc_id", F.concat_ws("/", "source", "lang").alias("cls"), X.tokenize(F.col("text")).alias("t"))


@query("g10_top_tokens", f"""
WITH tk AS (SELECT source || '/' || lang AS cls, doc_id, {Q.tokenize('text')} AS t FROM documents),
shared AS (SELECT cls, token FROM (SELECT cls, unnest(list_distinct(t)) AS token FROM tk) JOIN (SELECT cls, count(*) AS size FROM tk GROUP BY cls) USING (cls) GROUP BY cls, token, size HAVING count(*) = size AND size > 1),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY doc_id) AS q FROM tk) WHERE q <= 10),
pos AS (SELECT cls, q, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM head),
cnt AS (SELECT cls, token, count(*) AS n, min(q * 1000000 + i) AS seen FROM pos GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, seen) AS r FROM cnt),
lft AS (SELECT cls, token, n, row_number() OVER (PARTITION BY cls ORDER BY r) AS rank FROM cut ANTI JOIN shared USING (cls, token) WHERE r <= 15)
SELECT * FROM lft WHERE rank <= 8
""")
def g10(t):
    docs = document_class(t)
    shared = M.shared_tokens(docs, "cls", F.array_distinct("t"))
    return M.top_tokens(docs, "cls", "doc_id", F.col("t"), shared, first=10, cut=15, keep=8)


@query("g10_top_tokens_all", f"""
WITH tk AS (SELECT source || '/' || lang AS cls, doc_id, {Q.tokenize('text')} AS t FROM documents),
shared AS (SELECT cls, token FROM (SELECT cls, unnest(list_distinct(t)) AS token FROM tk) JOIN (SELECT cls, count(*) AS size FROM tk GROUP BY cls) USING (cls) GROUP BY cls, token, size HAVING count(*) = size AND size > 1),
pos AS (SELECT cls, doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM tk),
cnt AS (SELECT cls, token, count(*) AS n, min((doc_id, i)) AS seen FROM pos GROUP BY ALL)
SELECT cls, token, n, row_number() OVER (PARTITION BY cls ORDER BY n DESC, seen) AS rank FROM cnt ANTI JOIN shared USING (cls, token)
""")
def g10_all(t):
    docs = document_class(t)
    shared = M.shared_tokens(docs, "cls", F.array_distinct("t"))
    return M.top_tokens(docs, "cls", "doc_id", F.col("t"), shared)


@query("g11_shared_tokens", f"""
WITH tk AS (SELECT source || '/' || lang AS cls, {Q.tokenize('text')} AS t FROM documents)
SELECT cls, token FROM (SELECT cls, unnest(list_distinct(t)) AS token FROM tk) JOIN (SELECT cls, count(*) AS size FROM tk GROUP BY cls) USING (cls) GROUP BY cls, token, size HAVING count(*) = size AND size > 1
""")
def g11(t):
    return M.shared_tokens(document_class(t), "cls", F.array_distinct("t"))


@query("g13_vote", """
WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS domain, event_id FROM events),
c AS (SELECT user_id, domain, count(*) AS n, min(event_id) AS f FROM v WHERE domain <> 'none' GROUP BY ALL)
SELECT user_id, coalesce((SELECT domain FROM c WHERE c.user_id = u.user_id ORDER BY n DESC, f LIMIT 1), 'none') AS domain FROM (SELECT DISTINCT user_id FROM events) u
""")
def g13(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type")).alias("domain"))
    return M.vote(rows, "user_id", "domain", "event_id")


@query("g14_distinct_values", """
SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS classes FROM events WHERE value > 20 GROUP BY user_id
""")
def g14(t):
    return M.distinct_values(t.events.where("value > 20"), "user_id", "event_type").select("user_id", F.array_join("values", "|").alias("classes"))


@query("g15_distribution", """
WITH c AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT n AS size, count(*) AS conversations, round(count(*)::DOUBLE / (SELECT count(*) FROM c), 6) AS share, round(avg(kinds), 6) AS kinds FROM c GROUP BY n
""")
def g15(t):
    pairs = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    conv = pairs.groupBy("user_id").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
    sizes = conv.groupBy("size").agg(F.count(F.lit(1)).alias("conversations"), F.avg("kinds").alias("kinds"))
    total = sizes.agg(F.sum("conversations")).first()[0] or 0
    return sizes.select("size", "conversations", F.round(F.col("conversations") / F.lit(float(total)), 6).alias("share"), F.round("kinds", 6).alias("kinds"))


@query("g18_average_confidence", f"""
WITH {EMBEDDING_SCORES}, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS r FROM escores) WHERE r <= 3)
SELECT query, round(avg(score), 6) AS confidence FROM sel GROUP BY query
""")
def g18(t):
    scores = embedding_scores(t)
    chosen = L.top_k(scores, 3).select("query", "candidate")
    return M.average_confidence(scores, chosen, "query", "candidate", "score").select("query", F.round("confidence", 6).alias("confidence"))


@query("g20_compare_versions", """
SELECT event_type, round(avg(value) FILTER (WHERE day(ts) <= 15), 6) AS "old", round(avg(value) FILTER (WHERE day(ts) > 15), 6) AS "new",
 round(avg(value) FILTER (WHERE day(ts) > 15) - avg(value) FILTER (WHERE day(ts) <= 15), 6) AS delta FROM events GROUP BY event_type
""")
def g20(t):
    rows = t.events.withColumn("version", F.when(F.dayofmonth("ts") <= 15, "v1").otherwise("v2"))
    wide = M.compare_versions(rows, "event_type", "version", F.col("value"), "v1", "v2")
    return wide.select("event_type", *[F.round(c, 6).alias(c) for c in ("old", "new", "delta")])
