"""Passage retrieval: W-11, W-12, E-19, K-06, K-07."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.functions import words as W
from wayfind.operators import contain as H
from wayfind.operators import evaluate as K
from wayfind.operators import features as E
from wayfind.operators import retrieval as P
from wayfind.operators import similarity as S
from wayfind.operators.scale import hold_if_small
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query
from wayfind.plans.text_plans import CLAUSES_SQL

_MEM = "a-z0-9@_.''\\-"


def _mem(col):
    return Q.tokenize(col, W.MEMORY_STOP_WORDS, _MEM)


@query("w11_conversation_windows", f"""
WITH c AS (SELECT conv_id, turn, {CLAUSES_SQL.replace('{c}', 'text')} AS cl FROM conversations),
u AS (SELECT conv_id, turn, unnest(cl) AS clause, generate_subscripts(cl, 1) AS i FROM c),
n AS (SELECT conv_id, clause, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos FROM u)
SELECT a.conv_id, a.pos, concat_ws(' ', a.clause, b.clause, d.clause) AS passage FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1 LEFT JOIN n d ON d.conv_id = a.conv_id AND d.pos = a.pos + 2
""")
def w11(t):
    return P.conversation_windows(t.conversations, "conv_id", ["turn"], F.col("turn"), "text")


WINDOWS = f"""cl AS (SELECT doc_id, {CLAUSES_SQL.replace('{c}', 'text')} AS c FROM documents),
win AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(list_transform(c, lambda x, i: array_to_string(list_slice(c, i, i + 2), ' '))) AS passage FROM cl)"""


@query("w11_document_windows", f"WITH {WINDOWS} SELECT doc_id, pos, passage FROM win")
def w11_documents(t):
    return P.document_windows(t.documents, "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


KEYS = ["doc_id", "pos"]


SCORES = f"""{WINDOWS},
wt AS (SELECT printf('%019d-%09d', doc_id, pos) AS key, list_distinct({_mem('passage')}) AS words FROM win), c AS (SELECT * FROM wt WHERE len(words) > 0),
qt AS (SELECT item_id AS key, list_distinct({_mem('text')}) AS words FROM benchmark), q AS (SELECT * FROM qt WHERE len(words) > 0),
{Q.all_scores(E.MEMORY)}"""


def hits(t, k):
    return P.best_passages(P.encode_documents(t.documents, "doc_id", "text"), KEYS, t.benchmark, "item_id", "text", k)


@query("e19_window_scores", f"WITH {SCORES} {Q.top_k(50)}")
def e19(t):
    return hits(t, 50).select("query", F.format_string("%019d-%09d", *KEYS).alias("candidate"), "score", "rank")


ANSWERS = f"""{SCORES}, top AS ({Q.top_k(50)}),
answers AS (SELECT query, string_agg(passage, ' ' ORDER BY rank) AS answer FROM top JOIN win ON printf('%019d-%09d', doc_id, pos) = candidate GROUP BY query)"""


def answers(t):
    """Only the documents that were hit are cut into windows again."""
    found = hold_if_small(hits(t, 50))
    ids = found.select("doc_id").distinct()
    return P.answer(found, P.document_windows(t.documents.join(ids, "doc_id", "left_semi"), "doc_id", "text"), KEYS)


@query("w12_answer", f"WITH {ANSWERS} SELECT * FROM answers")
def w12(t):
    return answers(t)


def _plain(col):
    return Q.strip(f"regexp_replace(lower({col}), '[^a-z0-9_{Q.SPACE}]', '', 'g')")


@query("k06_contains_any", f"""
WITH p AS (SELECT doc_id, item_id, {_plain('d.text')} AS r, {_plain('b.text')} AS w FROM documents d JOIN benchmark b ON b.item_id % 20 = CAST(substring(d.source, 4) AS INTEGER))
SELECT doc_id, bool_or(w <> '' AND contains(r, w)) AS contained FROM p GROUP BY doc_id
""")
def k06(t):
    source = F.substring("source", 4, 10).cast("int")
    truths = t.benchmark.select((F.col("item_id") % 20).cast("int").alias("g"), F.col("text").alias("truth"))
    return K.contains_any_of(t.documents.withColumn("g", source), truths, ["g"], "doc_id", "text", "truth")


@query("k06_contains_all", f"""
WITH d AS (SELECT doc_id, {_plain('text')} AS r FROM documents), b AS (SELECT item_id, {_plain('text')} AS w FROM benchmark)
SELECT doc_id, count(*) FILTER (WHERE w <> '' AND contains(r, w)) AS found, bool_or(w <> '' AND contains(r, w)) AS contained FROM d, b GROUP BY doc_id
""")
def k06_all(t):
    """Every benchmark text against every document."""
    pairs = H.contained_in(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    found = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    rows = t.documents.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("found", F.lit(0)).alias("found"), F.col("found").isNotNull().alias("contained"))


@query("k07_eval_retrieval", f"""
WITH {ANSWERS} SELECT item_id AS query, {_plain('text')} <> '' AND contains({_plain("coalesce(answer, '')")}, {_plain('text')}) AS contained FROM benchmark LEFT JOIN answers ON query = item_id
""")
def k07(t):
    truth = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("expected"))
    return P.evaluate(answers(t), truth)
