"""J-*: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.functions import calls as C
from wayfind.operators import features as E
from wayfind.operators import joins as J
from wayfind.operators import rules as R
from wayfind.operators import similarity as S
from wayfind.operators.scale import Ordered, micros
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query
from wayfind.plans.rule_plans import HITS, word_rules


def numbered(t):
    """Calls of each conversation with their position."""
    ev = t.events.select("event_id", "user_id", "ts", "event_type", "value", "props")
    return Ordered(ev, ["user_id"], ["ts", "event_id"], micros("ts")).row_number("turn").result()


NUMBERED = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)"


@query("j01_join_truth", """
SELECT d.doc_id AS id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def j01(t):
    entries = t.documents.select(F.col("doc_id").alias("id"), "lang", "source")
    return J.join_truth(entries, t.labels.withColumnRenamed("doc_id", "id"))


def question_and_truth(t):
    """Two turn lists of different length per conversation: calls and purchases."""
    ev = numbered(t)
    q = ev.where("event_type <> 'error'").select("user_id", "ts", "event_id", F.col("event_type").alias("question"))
    q = Ordered(q, ["user_id"], ["ts", "event_id"], micros("ts")).row_number("turn").result()
    a = ev.where("event_type in ('purchase', 'view')").select("user_id", "ts", "event_id", F.col("value").alias("answer"))
    a = Ordered(a, ["user_id"], ["ts", "event_id"], micros("ts")).row_number("turn").result()
    return q.select(F.col("user_id").alias("id"), "turn", "question"), a.select(F.col("user_id").alias("id"), "turn", "answer")


QA = """qs AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS question FROM events WHERE event_type <> 'error'),
ans AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, value AS answer FROM events WHERE event_type IN ('purchase', 'view'))"""


@query("j02_align_turns", f"WITH {QA} SELECT id, turn, question, answer FROM qs JOIN ans USING (id, turn)")
def j02(t):
    return J.align_turns(*question_and_truth(t))


@query("j02_pad_turns", f"WITH {QA} SELECT id, turn, question, answer FROM qs FULL JOIN ans USING (id, turn)")
def j02_pad(t):
    return J.align_turns(*question_and_truth(t), pad=True)


@query("j03_candidates", """
SELECT item_id, doc_id, source FROM benchmark b JOIN documents d ON 'src' || (b.item_id % 20) = d.source
""")
def j03(t):
    entries = t.benchmark.select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    return J.candidates(entries, t.documents.select("doc_id", "source"), "source").select("item_id", "doc_id", "source")


@query("j04_expand_classes", """
SELECT c_custkey AS entry, pos AS class_pos, cls, s_suppkey AS func FROM (
  SELECT c_custkey, unnest([c_nationkey, (c_nationkey + 7) % 25]) AS cls, unnest([0, 1]) AS pos FROM customer) JOIN supplier ON s_nationkey = cls
""")
def j04(t):
    entries = t.customer.select(F.col("c_custkey").alias("entry"), F.array("c_nationkey", (F.col("c_nationkey") + 7) % 25).alias("classes"))
    catalog = t.supplier.select(F.col("s_nationkey").alias("cls"), F.col("s_suppkey").alias("func"))
    return J.expand_classes(entries, catalog)


@query("j05_lookup", """
SELECT c_custkey, c_nationkey, coalesce(r_name, 'none') AS pack FROM customer
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON c_nationkey = n_nationkey
""")
def j05(t):
    nation = t.nation.where("n_nationkey < 20")
    packs = nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("pack"))
    return J.lookup(t.customer.select("c_custkey", "c_nationkey"), packs, ["c_nationkey"], "pack", F.lit("none"))


@query("j06_resolve_bare", """
SELECT l_orderkey, l_linenumber, p.p_name AS bare, full_name FROM lineitem JOIN part p ON l_partkey = p_partkey
LEFT JOIN (SELECT p_name, arg_min(p_type || '.' || p_name, p_partkey) AS full_name FROM part WHERE p_size > 10 GROUP BY p_name) f ON f.p_name = p.p_name
""")
def j06(t):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("bare"))
    names = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey").drop("l_partkey")
    funcs = t.part.where("p_size > 10").select(F.col("p_name").alias("bare"), F.concat("p_type", F.lit("."), "p_name").alias("full_name"), F.col("p_partkey").alias("ord"))
    return J.resolve_bare(names, funcs)


def hit_rows(hit):
    # A plain explode would make Spark test the array with a filter below, which computes all hits a second time.
    one = hit.select("doc_id", F.explode_outer("hits").alias("h")).where("h is not null")
    return one.select("doc_id", "h.pattern", "h.canonical")


@query("j07_contains_join", f"WITH {HITS} SELECT doc_id, pattern, canonical FROM hits")
def j07(t):
    hit = R.phrase_hits(t.documents.select("doc_id", "text"), "doc_id", F.col("text"), word_rules(t))
    return hit_rows(hit)


# The same join when the rule table is too large for the plan: equi-join on the
# first characters of each phrase, then the containment test.
@query("j07_contains_join_large", f"WITH {HITS} SELECT doc_id, pattern, canonical FROM hits")
def j07_large(t):
    hit = R.phrase_hits(t.documents.select("doc_id", "text"), "doc_id", F.col("text"), word_rules(t), inline=0)
    return hit_rows(hit)


@query("j08_similarity_join", f"""
WITH q AS (SELECT item_id, unnest(list_distinct({Q.tokenize('text')})) AS w FROM benchmark), c AS (SELECT doc_id, unnest(list_distinct({Q.tokenize('text')})) AS w FROM documents)
SELECT item_id AS query, doc_id AS candidate, count(*) AS shared FROM q JOIN c USING (w) GROUP BY ALL
""")
def j08(t):
    from wayfind.plans.similarity_plans import benchmark_words, document_words

    return S.shared_counts(benchmark_words(t), document_words(t), E.MEMORY, "item_id", "doc_id")


@query("j09_uncalled", """
WITH pattern AS (SELECT user_id, p.event_type FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('purchase'), ('signup'), ('refund')) p(event_type))
SELECT user_id, event_type FROM pattern ANTI JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE value > 12) USING (user_id, event_type)
""")
def j09(t):
    wanted = F.array(*[F.lit(x) for x in ("click", "purchase", "signup", "refund")])
    pattern = t.events.select("user_id").distinct().select("user_id", F.explode(wanted).alias("event_type"))
    calls = t.events.where("value > 12").select("user_id", "event_type").distinct()
    return J.uncalled(pattern, calls, ["user_id", "event_type"])


@query("j10_dedupe_catalog", """
SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1
""")
def j10(t):
    docs = t.documents.select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    return J.dedupe_first(docs, F.col("h"), ["source", "doc_id"]).drop("h")
