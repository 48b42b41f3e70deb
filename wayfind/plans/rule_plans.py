"""F-*: rule matching. Rules come from the most frequent words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfind.functions import text as X
from wayfind.functions import words as W
from wayfind.operators import rules as R
from wayfind.operators.scale import local_table
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query

N_RULES = 60


def word_rules(t, n=N_RULES):
    """Rules from the ``n`` most frequent document words."""
    return t.once(f"word_rules_{n}", lambda: _word_rules(t, n))


def _word_rules(t, n):
    top = (
        t.documents.select(F.explode(X.tokenize(F.col("text"))).alias("pattern"))
        .groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pattern").limit(n)
    )
    # A rule table is kept as rows (here n): every use would count the words again.
    rows = [
        {"pattern": r["pattern"], "canonical": f"a{i % 7}", "cls": f"c{i % 4}", "ordinal": i, "weight": 1 + i % 5}
        for i, r in enumerate(top.collect(), 1)
    ]
    return local_table(t.spark, rows, StructType.fromDDL("pattern string, canonical string, cls string, ordinal int, weight int"))


CLASSES = ["c0", "c1", "c2", "c3"]

RULES = f"""rules AS (
  SELECT pattern, 'a' || (ordinal % 7) AS canonical, 'c' || (ordinal % 4) AS cls, ordinal, 1 + ordinal % 5 AS weight FROM (
    SELECT pattern, row_number() OVER (ORDER BY n DESC, pattern) AS ordinal FROM (
      SELECT pattern, count(*) AS n FROM (SELECT unnest({Q.tokenize('text')}) AS pattern FROM documents) GROUP BY pattern
      ORDER BY n DESC, pattern LIMIT {N_RULES})))"""

# Phrase hits of every document.
HITS = f"""{RULES},
hits AS (SELECT doc_id, r.* FROM documents d JOIN rules r ON contains(lower(d.text), r.pattern))"""

# Word hits of every document; words split at every character outside a-z0-9.
WORDS = f"""{RULES},
tok AS (SELECT doc_id, unnest(w) AS pattern, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {Q.tokenize_spaced('text')} AS w FROM documents)),
whits AS (SELECT t.doc_id, t.pos, r.* FROM tok t JOIN rules r USING (pattern))"""


def _doc_phrases(t):
    return R.phrase_hits(t.documents.select("doc_id", "text"), "doc_id", F.col("text"), word_rules(t))


def _doc_words(t, tokens=X.tokenize_spaced):
    docs = t.documents.select("doc_id", tokens(F.col("text")).alias("tokens"))
    return R.word_hits(docs, "doc_id", F.col("tokens"), word_rules(t))


@query("f01_match_longest", f"""
WITH {HITS} SELECT d.doc_id, coalesce((SELECT canonical FROM hits h WHERE h.doc_id = d.doc_id ORDER BY length(pattern) DESC, ordinal LIMIT 1), 'none') AS action FROM documents d
""")
def f01(t):
    return _doc_phrases(t).select("doc_id", R.longest(F.col("hits")).alias("action"))


@query("f02_match_first", f"""
WITH {HITS} SELECT d.doc_id, coalesce((SELECT canonical FROM hits h WHERE h.doc_id = d.doc_id ORDER BY ordinal LIMIT 1), 'none') AS action FROM documents d
""")
def f02(t):
    return _doc_phrases(t).select("doc_id", R.first_listed(F.col("hits")).alias("action"))


# Verbs and nouns of the part names: "adjective noun".
def part_rules(t, position, offset):
    words = t.part.select(F.get(X.intent_words(F.col("p_name")), F.lit(position)).alias("pattern")).distinct()
    # The ordinal comes from the word itself: no global order is needed.
    ranked = words.withColumn("ordinal", F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int"))
    return ranked.select(
        "pattern", F.concat(F.lit("m"), ((F.col("ordinal") + offset) % 5).cast("string")).alias("canonical"),
        F.lit("").alias("cls"), "ordinal", (1 + F.col("ordinal") % 3).alias("weight"),
    ).where("ordinal % 4 <> 0")


def _part_rules_sql(name, position, offset):
    return f"""{name} AS (SELECT * FROM (SELECT pattern, 'm' || ((ordinal + {offset}) % 5) AS canonical, ordinal, 1 + ordinal % 3 AS weight FROM (
  SELECT pattern, CAST('0x' || substring(md5(pattern), 1, 4) AS INTEGER) AS ordinal FROM (SELECT DISTINCT ({Q.intent_words('p_name')})[{position + 1}] AS pattern FROM part)))
  WHERE ordinal % 4 <> 0)"""


PART_WORDS = f"""{_part_rules_sql('verbs', 0, 0)}, {_part_rules_sql('nouns', 1, 2)},
pw AS (SELECT p_partkey, unnest(w) AS pattern, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT p_partkey, {Q.intent_words("p_brand || ' ' || p_name || ' ' || p_type")} AS w FROM part)),
vhits AS (SELECT p_partkey, pos, v.* FROM pw JOIN verbs v USING (pattern)),
nhits AS (SELECT p_partkey, pos, v.* FROM pw JOIN nouns v USING (pattern)),
acts AS (SELECT p_partkey, coalesce((SELECT canonical FROM vhits h WHERE h.p_partkey = p.p_partkey AND pos = 0),
   (SELECT canonical FROM vhits h WHERE h.p_partkey = p.p_partkey ORDER BY weight DESC, pos LIMIT 1), 'none') AS action,
   coalesce((SELECT canonical FROM nhits h WHERE h.p_partkey = p.p_partkey ORDER BY pos LIMIT 1), 'none') AS target FROM part p)"""


def part_intent(t):
    """Parts with their action and target."""
    text = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    parts = t.part.withColumn("text", text).withColumn("tokens", X.intent_words(F.col("text")))
    hit = R.word_hits(parts, "p_partkey", F.col("tokens"), part_rules(t, 0, 0), "verb_hits")
    hit = R.word_hits(hit, "p_partkey", F.col("tokens"), part_rules(t, 1, 2), "noun_hits")
    none = F.array().cast(R.HIT_TYPE)
    return hit.withColumn("action", R.action(none, F.col("verb_hits"))).withColumn("target", R.first_word(F.col("noun_hits")))


@query("f03_match_word", f"""
WITH {PART_WORDS} SELECT p_partkey, coalesce((SELECT canonical FROM vhits h WHERE h.p_partkey = p.p_partkey ORDER BY pos LIMIT 1), 'none') AS action FROM part p
""")
def f03(t):
    return part_intent(t).select("p_partkey", R.first_word(F.col("verb_hits")).alias("action"))


@query("f04_extract_action", f"""
WITH {WORDS},
ph AS (SELECT d.doc_id, (SELECT canonical FROM rules r WHERE contains(lower(d.lang || d.source || d.text), r.pattern) AND length(r.pattern) > 5 ORDER BY length(r.pattern) DESC, ordinal LIMIT 1) AS c FROM documents d)
SELECT d.doc_id, coalesce(ph.c, (SELECT canonical FROM whits h WHERE h.doc_id = d.doc_id AND pos = 0),
  (SELECT canonical FROM whits h WHERE h.doc_id = d.doc_id ORDER BY weight DESC, pos LIMIT 1), 'none') AS action
FROM documents d JOIN ph USING (doc_id)
""")
def f04(t):
    rules = word_rules(t)
    docs = t.documents.select(
        "doc_id", F.concat("lang", "source", F.col("text")).alias("head"),
        X.tokenize_spaced(F.col("text")).alias("tokens"),
    )
    hit = R.phrase_hits(docs, "doc_id", F.col("head"), rules.where(F.length("pattern") > 5), "phrases")
    hit = R.word_hits(hit, "doc_id", F.col("tokens"), rules, "verbs")
    return hit.select("doc_id", R.action(F.col("phrases"), F.col("verbs")).alias("action"))


@query("f05_extract_target", f"WITH {PART_WORDS} SELECT p_partkey, target FROM acts")
def f05(t):
    return part_intent(t).select("p_partkey", "target")


@query("f06_all_actions", f"""
WITH {RULES},
tok AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS pattern FROM documents),
m AS (SELECT doc_id, 0 AS stage, -length(pattern) AS k, ordinal, canonical FROM documents d JOIN rules r ON length(r.pattern) > 4 AND contains(lower(d.text), r.pattern)
  UNION ALL SELECT doc_id, 1, 0, ordinal, canonical FROM tok JOIN rules USING (pattern) WHERE length(pattern) BETWEEN 4 AND 4),
o AS (SELECT doc_id, canonical, min(struct_pack(stage := stage, k := k, o := ordinal)) AS first FROM m GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(canonical, '|' ORDER BY first), '') AS actions FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id
""")
def f06(t):
    rules = word_rules(t)
    docs = t.documents.select("doc_id", "text", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("tokens"))
    hit = R.phrase_hits(docs, "doc_id", F.col("text"), rules.where(F.length("pattern") > 4), "phrases")
    hit = R.word_hits(hit, "doc_id", F.array_distinct("tokens"), rules.where(F.length("pattern") == 4), "words")
    return hit.select("doc_id", F.array_join(R.all_canonicals(F.col("phrases"), F.col("words")), "|").alias("actions"))


@query("f07_intent", f"""
WITH {PART_WORDS} SELECT p_partkey, action, target,
 {Q.joined(Q.without(f"string_split_regex({Q.split_name('p_brand || chr(32) || p_name || chr(32) || p_type')}, '[^a-z0-9]+')", W.STOP_WORDS + W.KEYWORD_EXTRA_STOP_WORDS))} AS keywords
FROM part JOIN acts USING (p_partkey)
""")
def f07(t):
    return part_intent(t).select("p_partkey", "action", "target", X.keywords(F.col("text")).alias("keywords"))


@query("f08_leading_override", f"""
WITH {PART_WORDS} SELECT p_partkey, CASE WHEN ({Q.intent_words('p_name')})[1] IN ('small', 'old') AND contains(lower(p_name), 'bolt') THEN 'forced' ELSE action END AS action
FROM part JOIN acts USING (p_partkey)
""")
def f08(t):
    first = F.get(X.intent_words(F.col("p_name")), F.lit(0))
    return part_intent(t).select(
        "p_partkey", R.leading_override(first, F.col("p_name"), ("small", "old"), "bolt", "forced", F.col("action")).alias("action")
    )


@query("f09_detect_functions", f"WITH {HITS} SELECT DISTINCT doc_id, canonical AS func FROM hits")
def f09(t):
    return _doc_phrases(t).select("doc_id", F.explode(R.listed_canonicals(F.col("hits"))).alias("func"))


REGEX_RULES = (
    (r"[0-9]{3,}", "numbers"),
    (r"https?://", "link"),
    (r"@[a-z]", "mention"),
    (r"(^|[^a-z])the[^a-z].*(^|[^a-z])and[^a-z]", "english"),
    (r"license|copyright", "legal"),
    (r"[|]", "table"),
)


@query("f10_detect_regex", f"""
WITH {HITS} SELECT d.doc_id, coalesce(nullif(concat_ws('|', {", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for p, n in REGEX_RULES)}), ''),
  coalesce((SELECT canonical FROM hits h WHERE h.doc_id = d.doc_id ORDER BY ordinal LIMIT 1), 'none')) AS labels FROM documents d
""")
def f10(t):
    labels = F.array_join(R.regex_labels(F.lower("text"), REGEX_RULES), "|")
    # No pattern matched: the best single rule decides.
    return _doc_phrases(t).select("doc_id", F.coalesce(F.nullif(labels, F.lit("")), R.first_listed(F.col("hits"))).alias("labels"))


@query("f11_detect_class", f"""
WITH {WORDS},
s AS (SELECT doc_id, cls, CAST(sum(w) AS BIGINT) AS score FROM (
  SELECT DISTINCT doc_id, cls, ordinal, 3 AS w FROM whits
  UNION ALL SELECT doc_id, cls, ordinal, 5 FROM documents d JOIN rules r ON length(pattern) > 5 AND contains(lower(d.text), r.pattern)
  UNION ALL SELECT DISTINCT doc_id, 'c' || (ordinal % 3), ordinal + 100, weight FROM whits) GROUP BY ALL)
SELECT d.doc_id, coalesce((SELECT cls FROM s WHERE s.doc_id = d.doc_id ORDER BY score DESC, cls LIMIT 1), 'c0') AS cls FROM documents d
""")
def f11(t):
    rules = word_rules(t)
    docs = t.documents.select("doc_id", "text", F.array_distinct(X.tokenize_spaced(F.col("text"))).alias("tokens"))
    signals = rules.withColumn("cls", F.concat(F.lit("c"), (F.col("ordinal") % 3).cast("string"))).withColumn("ordinal", F.col("ordinal") + 100)
    words = rules.withColumn("weight", F.lit(3)).unionByName(signals)
    hit = R.word_hits(docs, "doc_id", F.col("tokens"), words, "word_hits")
    hit = R.phrase_hits(hit, "doc_id", F.col("text"), rules.where(F.length("pattern") > 5).withColumn("weight", F.lit(5)), "phrases")
    return hit.select("doc_id", R.best_class(F.concat("word_hits", "phrases"), CLASSES).alias("cls"))


@query("f12_detect_domain", f"""
WITH {WORDS}, s AS (SELECT doc_id, cls, count(DISTINCT pattern) AS n FROM whits GROUP BY ALL)
SELECT d.doc_id, coalesce((SELECT cls FROM s WHERE s.doc_id = d.doc_id ORDER BY n DESC, cls LIMIT 1), 'none') AS domain FROM documents d
""")
def f12(t):
    docs = t.documents.select("doc_id", F.array_distinct(X.tokenize_spaced(F.col("text"))).alias("tokens"))
    hit = R.word_hits(docs, "doc_id", F.col("tokens"), word_rules(t).withColumn("weight", F.lit(1)))
    return hit.select("doc_id", R.best_domain(F.col("hits"), CLASSES).alias("domain"))


@query("f13_is_suppressed", f"WITH {PART_WORDS} SELECT p_partkey, action = 'none' AND target = 'none' AS suppressed FROM acts")
def f13(t):
    return part_intent(t).select("p_partkey", R.is_suppressed(F.col("action"), F.col("target")).alias("suppressed"))


@query("f14_keep_available", """
SELECT event_id, e.user_id, e.event_type AS func FROM events e
WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.value > 15)
""")
def f14(t):
    calls = t.events.select("event_id", "user_id", F.col("event_type").alias("func"))
    available = t.events.where("value > 15").select("user_id", F.col("event_type").alias("func")).distinct()
    return R.keep_available(calls, available, ["user_id", "func"])


@query("f15_exclude", """
SELECT event_id, e.user_id, e.event_type AS func FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.value > 40)
""")
def f15(t):
    calls = t.events.select("event_id", "user_id", F.col("event_type").alias("func"))
    excluded = t.events.where("value > 40").select("user_id", F.col("event_type").alias("func")).distinct()
    return R.exclude(calls, excluded, ["user_id", "func"])


PAIRS = (("click", "view"), ("view", "click"), ("purchase", "signup"))


def type_scores(t):
    """Candidate functions of every conversation, scored by their largest value."""
    return t.events.groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("func")).agg(F.max("value").alias("score"))


@query("f16_apply_exclusion", f"""
WITH c AS (SELECT user_id AS query, event_type AS func, max(value) AS score FROM events GROUP BY ALL),
p(func, rival) AS (VALUES {", ".join(str(p) for p in PAIRS)}),
l AS (SELECT a.query, CASE WHEN b.score > a.score THEN a.func ELSE b.func END AS func FROM c a JOIN p USING (func) JOIN c b ON b.query = a.query AND b.func = p.rival)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.query = c.query AND l.func = c.func)
""")
def f16(t):
    pairs = t.spark.createDataFrame(list(PAIRS), "func string, rival string")
    return R.apply_exclusion(type_scores(t), pairs)


@query("f17_above_threshold", """
SELECT user_id AS query, event_type AS func, max(value) AS score FROM events GROUP BY ALL HAVING max(value) > 30
""")
def f17(t):
    return R.above(type_scores(t), 30.0)
