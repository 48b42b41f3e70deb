"""X-* set operations, G-16/G-17 and the turn analysis built on them.

Prediction: the calls of a conversation and day whose value is small; truth: those
of even event id.  The two overlap in part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.config import shared_folder
from wayfind.operators import metrics as M
from wayfind.operators import sets as S
from wayfind.operators.scale import Ordered, micros
from wayfind.plans.registry import query
from wayfind.sources import jsonl as J

TURN = ["user_id", "day"]


def sides(t):
    ev = t.events.select("user_id", F.unix_date(F.to_date("ts")).alias("day"), F.col("event_type").alias("func"), "ts", "event_id", "value")
    return ev.where("value < 14").drop("value"), ev.where("event_id % 4 <> 0").drop("value")


SIDES = """ev AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, event_type AS func, ts, event_id, value FROM events),
pred AS (SELECT * FROM ev WHERE value < 14), truth AS (SELECT * FROM ev WHERE event_id % 4 <> 0),
cnt AS (SELECT user_id, day, func, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(t) AS BIGINT) AS n_true FROM (
  SELECT user_id, day, func, 1 AS p, 0 AS t FROM pred UNION ALL SELECT user_id, day, func, 0, 1 FROM truth) GROUP BY ALL)"""


def counted(t):
    return S.counts(*sides(t), TURN, "func")


@query("x01_union_categories", "SELECT event_type AS category, event_id, user_id FROM events")
def x01(t):
    """The files of all categories, told apart by their place, in one scan."""
    path = shared_folder(t.spark)
    J.write_jsonl(t.events.select("event_id", "user_id", "event_type"), path, "event_type")
    return J.read_categories(t.spark, J.list_categories(t.spark, path, "event_type"), "event_id bigint, user_id bigint")


@query("x02_set_equal", f"WITH {SIDES} SELECT user_id, day, bool_and((n_pred > 0) = (n_true > 0)) AS equal FROM cnt GROUP BY ALL")
def x02(t):
    return S.set_equal(counted(t), TURN)


@query("x03_multiset_equal", f"""
WITH {SIDES}, a AS (SELECT user_id, day, list(func ORDER BY func) AS f FROM pred GROUP BY ALL), b AS (SELECT user_id, day, list(func ORDER BY func) AS g FROM truth GROUP BY ALL)
SELECT user_id, day, coalesce(f, []) = coalesce(g, []) AS equal FROM a FULL JOIN b USING (user_id, day)
""")
def x03(t):
    return S.multiset_equal(counted(t), TURN)


@query("x04_multiset_diff", f"WITH {SIDES} SELECT *, greatest(n_true - n_pred, 0) AS missing, greatest(n_pred - n_true, 0) AS extra FROM cnt")
def x04(t):
    return S.multiset_diff(counted(t))


@query("x04_except_all", f"WITH {SIDES} SELECT user_id, day, func FROM (SELECT user_id, day, func FROM truth EXCEPT ALL SELECT user_id, day, func FROM pred)")
def x04_except(t):
    pred, truth = sides(t)
    return truth.select(*TURN, "func").exceptAll(pred.select(*TURN, "func"))


PATH = """path AS (SELECT user_id, matched, expected, CASE WHEN expected > 0 THEN matched::DOUBLE / expected ELSE 1 END AS path_accuracy FROM (
  SELECT user_id, CAST(sum(least(n_pred, n_true)) AS BIGINT) AS matched, CAST(sum(n_true) AS BIGINT) AS expected FROM (
    SELECT user_id, func, sum(n_pred) AS n_pred, sum(n_true) AS n_true FROM cnt GROUP BY ALL) GROUP BY user_id))"""


def path(t):
    return S.path_accuracy(S.counts(*sides(t), ["user_id"], "func"), ["user_id"])


@query("x05_path_accuracy", f"WITH {SIDES}, {PATH} SELECT *, path_accuracy >= 0.5 AS passed FROM path")
def x05(t):
    return path(t)


@query("x06_sequence_equal", f"""
WITH {SIDES}, a AS (SELECT user_id, day, list(func ORDER BY ts, event_id) AS f FROM pred GROUP BY ALL), b AS (SELECT user_id, day, list(func ORDER BY ts, event_id) AS g FROM truth GROUP BY ALL)
SELECT user_id, day, coalesce(f, []) = coalesce(g, []) AS equal FROM a FULL JOIN b USING (user_id, day)
""")
def x06(t):
    pred, truth = (Ordered(d, TURN, ["ts", "event_id"], micros("ts")).row_number("pos").result() for d in sides(t))
    return S.sequence_equal(pred, truth, TURN, "pos", "func")


@query("x07_intersect_all", """
SELECT event_type FROM (SELECT DISTINCT user_id % 10 AS g, event_type FROM events WHERE value > 30) GROUP BY event_type HAVING count(*) = (SELECT count(DISTINCT user_id % 10) FROM events WHERE value > 30)
""")
def x07(t):
    rows = t.events.where("value > 30").select((F.col("user_id") % 10).alias("g"), "event_type").distinct()
    groups = rows.select("g").distinct().count()
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == groups).select("event_type")


@query("x08_ordered_union", f"""
WITH {SIDES}, s AS (SELECT user_id, func, 0 AS stage, event_id AS o FROM pred UNION ALL SELECT user_id, func, 1, event_id FROM truth),
f AS (SELECT user_id, func, min(stage * 10000000000 + o) AS pos FROM s GROUP BY ALL) SELECT user_id, string_agg(func, '|' ORDER BY pos) AS called FROM f GROUP BY user_id
""")
def x08(t):
    pred, truth = sides(t)
    return S.ordered_union(pred, truth, ["user_id"], "func", "event_id").select("user_id", F.array_join("names", "|").alias("called"))


@query("g16_error_counts", f"""
WITH {SIDES}, d AS (SELECT func, greatest(n_true - n_pred, 0) AS missing, greatest(n_pred - n_true, 0) AS extra FROM cnt)
SELECT * FROM (SELECT 'missing' AS kind, func, CAST(sum(missing) AS BIGINT) AS n FROM d GROUP BY func HAVING sum(missing) > 0 ORDER BY n DESC, func LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'extra', func, CAST(sum(extra) AS BIGINT) AS n FROM d GROUP BY func HAVING sum(extra) > 0 ORDER BY n DESC, func LIMIT 20)
""")
def g16(t):
    diff = S.multiset_diff(counted(t))

    def side(kind):
        sums = diff.groupBy("func").agg(F.sum(kind).alias("n")).where("n > 0")
        return sums.orderBy(F.desc("n"), "func").limit(20).select(F.lit(kind).alias("kind"), "func", "n")

    return side("missing").unionByName(side("extra"))


EXACT = "exact AS (SELECT user_id, day, bool_and(n_pred = n_true) AS exact FROM cnt GROUP BY ALL)"


@query("g17_perfect_entries", f"WITH {SIDES}, {EXACT} SELECT user_id, bool_and(exact) AS perfect FROM exact GROUP BY user_id")
def g17(t):
    return M.perfect(S.multiset_equal(counted(t), TURN).withColumnRenamed("equal", "exact"), "user_id", "exact")


@query("k08_turn_analysis", f"""
WITH {SIDES}, {EXACT}, cls AS (SELECT user_id, 'c' || (user_id % 4) AS cls FROM (SELECT DISTINCT user_id FROM events)),
d AS (SELECT user_id, day, CAST(sum(greatest(n_true - n_pred, 0)) AS BIGINT) AS missing, CAST(sum(greatest(n_pred - n_true, 0)) AS BIGINT) AS extra FROM cnt GROUP BY ALL)
SELECT cls, count(*) AS turns, CAST(sum(CAST(exact AS INTEGER)) AS BIGINT) AS exact_turns, count(DISTINCT user_id) AS entries,
 CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra, round(avg(CAST(exact AS INTEGER)), 6) AS accuracy FROM exact JOIN d USING (user_id, day) JOIN cls USING (user_id) GROUP BY cls
""")
def k08(t):
    from wayfind.operators.evaluate import turn_analysis

    out = turn_analysis(counted(t), "user_id", TURN, F.concat(F.lit("c"), F.col("user_id") % 4))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("k09_path_per_conversation", f"""
WITH {SIDES}, {PATH} SELECT count(*) AS conversations, CAST(sum(CASE WHEN path_accuracy >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(avg(path_accuracy), 6) AS mean_path_accuracy FROM path
""")
def k09(t):
    from wayfind.operators.evaluate import path_summary

    return path_summary(path(t)).withColumn("mean_path_accuracy", F.round("mean_path_accuracy", 6))


@query("k11_padded_turns", f"""
WITH {SIDES}, a AS (SELECT user_id, day, count(*) AS p FROM pred GROUP BY ALL), b AS (SELECT user_id, day, count(*) AS q FROM truth GROUP BY ALL)
SELECT user_id, day, coalesce(p, 0) AS n_pred, coalesce(q, 0) AS n_true, p IS NULL OR q IS NULL AS padded FROM a FULL JOIN b USING (user_id, day)
""")
def k11(t):
    from wayfind.operators.evaluate import pad_turns

    return pad_turns(*sides(t), TURN)
