"""P-*: text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.functions import calls as C
from wayfind.functions import schema as S
from wayfind.functions import text as X
from wayfind.functions import words as W
from wayfind.plans import sqltext as Q
from wayfind.plans.registry import query


@query("p01_split_name", f"""
SELECT p_partkey, {Q.split_name("p_brand || '_' || p_name || 'HotGear.x-y'")} AS words FROM part
""")
def p01(t):
    name = F.concat("p_brand", F.lit("_"), "p_name", F.lit("HotGear.x-y"))
    return t.part.select("p_partkey", X.split_name(name).alias("words"))


def _token_query(name, spark_fn, sql_fn, table="documents", key="doc_id", col="text"):
    @query(name, f"""
    SELECT {key}, {Q.joined('t')} AS tokens, CAST(len(t) AS BIGINT) AS n
    FROM (SELECT {key}, {sql_fn(col)} AS t FROM {table})
    """)
    def run(t):
        tokens = spark_fn(F.col(col))
        return getattr(t, table).select(
            key, F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("bigint").alias("n")
        )

    return run


_token_query("p02_tokenize", X.tokenize, Q.tokenize)
_token_query("p02_tokenize_benchmark", X.tokenize, Q.tokenize, "benchmark", "item_id")
_token_query("p03_generic_tokens", X.generic_tokens, lambda c: Q.tokenize(c, W.STOP_WORDS + W.GENERIC_WORDS))
_token_query("p04_noun_tokens", X.noun_tokens, lambda c: Q.tokenize(c, W.STOP_WORDS + W.FILLER_WORDS))


@query("p05_memory_tokens", f"""
SELECT conv_id, turn, {Q.joined(Q.tokenize('text', W.MEMORY_STOP_WORDS, "a-z0-9@_.''\\-"))} AS tokens FROM conversations
""")
def p05(t):
    return t.conversations.select("conv_id", "turn", F.array_join(X.memory_tokens(F.col("text")), " ").alias("tokens"))


@query("p06_bag", f"""
WITH x AS (SELECT item_id, {Q.tokenize('text')} AS t FROM benchmark),
w AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM x),
f AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT item_id AS key, coalesce(string_agg(w, ' ' ORDER BY i), 'none') AS bag FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id
UNION ALL
SELECT 1000000 + doc_id, coalesce((SELECT string_agg(w, ' ' ORDER BY i) FROM
  (SELECT w, min(i) AS i FROM (SELECT unnest(tk) AS w, generate_subscripts(tk, 1) AS i) GROUP BY w)), 'none')
FROM (SELECT doc_id, {Q.tokenize('text')} AS tk FROM documents)
""")
def p06(t):
    bag = X.bag(X.tokenize(F.col("text"))).alias("bag")
    return t.benchmark.select(F.col("item_id").alias("key"), bag).unionByName(
        t.documents.select((F.col("doc_id") + 1000000).alias("key"), bag)
    )


@query("p07_clean_description", f"""
SELECT page_id, lang_form, {Q.strip(f"regexp_replace(cut, '^{W.FILLER_OPENING}[,{Q.SPACE}]*', '', 'i')")} AS cleaned FROM (
  SELECT page_id, 'first' AS lang_form, CASE WHEN contains(d, 'Tool description:')
      THEN regexp_replace(d, '^.*?Tool description:[{Q.SPACE}]*', '', 'is') ELSE d END AS cut
  FROM (SELECT page_id, 'This tool belongs to ' || url || '. Tool description: Returns the ' || html AS d FROM pages)
  UNION ALL
  SELECT page_id, 'last', regexp_replace(d, '^.*Tool description:[{Q.SPACE}]*', '', 'is')
  FROM (SELECT page_id, 'x Tool description: ' || html || ' tool description: This function, ' || url AS d FROM pages)
)
""")
def p07(t):
    first = F.concat(F.lit("This tool belongs to "), "url", F.lit(". Tool description: Returns the "), "html")
    last = F.concat(F.lit("x Tool description: "), "html", F.lit(" tool description: This function, "), "url")
    pages = t.pages
    return pages.select("page_id", F.lit("first").alias("lang_form"), X.clean_description(first).alias("cleaned")).unionByName(
        pages.select("page_id", F.lit("last").alias("lang_form"), X.clean_description(last, True).alias("cleaned"))
    )


def part_properties():
    """A parameter schema per part, built from its columns."""

    def spec(kind, description, enum=None, default=None):
        return F.struct(
            F.lit(kind).alias("type"),
            description.alias("description"),
            (enum if enum is not None else F.lit(None).cast("array<string>")).alias("enum"),
            (default if default is not None else F.lit(None).cast("string")).alias("default"),
        )

    return F.create_map(
        F.lit("partKey"), spec("integer", F.concat(F.lit("The key of the "), "p_name")),
        F.lit("brand_name"), spec("string", F.lit(None).cast("string"), F.array("p_brand", "p_type", F.lit("Any-Brand"))),
        F.lit("size"), spec("float", F.concat(F.lit("Value of size for the "), "p_type", F.lit(" "), "p_name", F.lit(" part in a box")),
                            default=F.col("p_size").cast("string")),
        F.lit("a"), spec(None, F.lit("")),
    ).cast(S.PROPERTIES)


_KEY_DESC = "'The key of the ' || p_name"
_SIZE_DESC = "'Value of size for the ' || p_type || ' ' || p_name || ' part in a box'"
_ENUM = f"list_concat(list_concat({Q.tokenize('p_brand')}, {Q.tokenize('p_type')}), {Q.tokenize(chr(39) + 'Any-Brand' + chr(39))})"


def _cat(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


PARAM_TOKENS_SQL = Q.without(
    _cat("['part','key']", Q.tokenize(_KEY_DESC), "['integer']", "['brand','name']", _ENUM,
         "['size']", Q.tokenize(_SIZE_DESC), "['float']", "['a']"),
    W.STOP_WORDS,
)
PARAM_TOKENS_UNTYPED_SQL = Q.without(
    _cat("['part','key']", Q.tokenize(_KEY_DESC), "['brand','name']", _ENUM, "['size']", Q.tokenize(_SIZE_DESC), "['a']"),
    W.STOP_WORDS,
)


@query("p08_param_tokens", f"""
SELECT p_partkey, {Q.joined(PARAM_TOKENS_SQL)} AS tokens, {Q.joined(PARAM_TOKENS_UNTYPED_SQL)} AS untyped FROM part
""")
def p08(t):
    props = part_properties()
    return t.part.select(
        "p_partkey",
        F.array_join(S.param_tokens(props), " ").alias("tokens"),
        F.array_join(S.param_tokens(props, with_type=False), " ").alias("untyped"),
    )


_GENERIC = W.STOP_WORDS + W.GENERIC_WORDS


@query("p09_param_names", f"""
SELECT p_partkey, {Q.joined(Q.without(_cat("['part','key','brand','name','size','a']",
    f"{Q.tokenize(_KEY_DESC, _GENERIC)}", f"{Q.tokenize(_SIZE_DESC, _GENERIC)}"), _GENERIC))} AS tokens
FROM part
""")
def p09(t):
    return t.part.select("p_partkey", F.array_join(S.param_names(part_properties()), " ").alias("tokens"))


@query("p10_param_types", f"""
SELECT p_partkey, 'integer string float string' AS types,
  {Q.joined(_cat(f"{Q.tokenize(_KEY_DESC)}", "[lower(p_brand), lower(p_type), 'any-brand']",
                 f"{Q.tokenize(_SIZE_DESC)}", "[CAST(p_size AS VARCHAR)]"))} AS entities
FROM part
""")
def p10(t):
    props = part_properties()
    return t.part.select(
        "p_partkey",
        F.array_join(S.param_types(props), " ").alias("types"),
        F.array_join(S.param_entities(props), " ").alias("entities"),
    )


_QP = "list_concat(list_concat(regexp_extract_all({c}, '\"([^\"]*)\"', 1), regexp_extract_all({c}, '''([^'']*)''', 1)), regexp_extract_all({c}, '\\b\\d+\\.?\\d*\\b'))"


@query("p11_query_params", f"""
WITH x AS (
  SELECT 'e' || event_id AS key, props || ' it''s "' || event_type || '" for ' || CAST(user_id AS VARCHAR) || '.5 ' || event_type AS s FROM events
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
y AS (SELECT key, list_concat({_QP.format(c='s')}, {Q.tokenize('s')}) AS t FROM x)
SELECT key, coalesce((SELECT string_agg(w, '|' ORDER BY i) FROM
  (SELECT w, min(i) AS i FROM (SELECT unnest(t) AS w, generate_subscripts(t, 1) AS i) GROUP BY w)), '') AS tokens FROM y
""")
def p11(t):
    sentence = F.concat("props", F.lit(" it's \""), "event_type", F.lit('" for '), F.col("user_id").cast("string"), F.lit(".5 "), "event_type")
    rows = t.events.select(F.concat(F.lit("e"), F.col("event_id")).alias("key"), sentence.alias("s")).unionByName(
        t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"), F.col("text").alias("s"))
    )
    return rows.select("key", F.array_join(X.query_params(F.col("s")), "|").alias("tokens"))


@query("p12_entities", f"""
WITH y AS (SELECT doc_id, list_concat(list_concat(list_concat(regexp_extract_all(text, '''([^'']*)''', 1), regexp_extract_all(text, '"([^"]*)"', 1)),
   list_concat(regexp_extract_all(text, '\\b[\\w-]+\\.[\\w]+\\b'), regexp_extract_all(text, '\\b\\d+\\.?\\d*\\b'))), regexp_extract_all(text, '@(\\w+)', 1)) AS t FROM documents)
SELECT doc_id, coalesce((SELECT string_agg(w, '|' ORDER BY i) FROM
  (SELECT w, min(i) AS i FROM (SELECT unnest(t) AS w, generate_subscripts(t, 1) AS i) GROUP BY w)), '') AS entities FROM y
""")
def p12(t):
    return t.documents.select("doc_id", F.array_join(X.entities(F.col("text")), "|").alias("entities"))


_token_query(
    "p13_keywords",
    lambda c: F.split(X.keywords(c), " "),
    lambda c: f"CASE WHEN len({Q.without(f'string_split_regex({Q.split_name(c)}, {chr(39)}[^a-z0-9]+{chr(39)})', W.STOP_WORDS + W.KEYWORD_EXTRA_STOP_WORDS)}) = 0 THEN [''] ELSE "
    + Q.without(f"string_split_regex({Q.split_name(c)}, '[^a-z0-9]+')", W.STOP_WORDS + W.KEYWORD_EXTRA_STOP_WORDS) + " END",
)


@query("p14_what_tokens", f"""
SELECT doc_id, {Q.joined("CASE WHEN len(u) > 0 THEN u ELSE t END")} AS tokens FROM (
  SELECT doc_id, t, list_filter(t, lambda w: not list_contains({Q.words_list(W.HOW_WORDS)}, w)) AS u
  FROM (SELECT doc_id, {Q.tokenize("'show me ' || text")} AS t FROM documents
        UNION ALL SELECT -1 - doc_id, {Q.tokenize("'give help via ' || lang")} FROM documents))
""")
def p14(t):
    docs = t.documents
    rows = docs.select("doc_id", X.tokenize(F.concat(F.lit("show me "), "text")).alias("t")).unionByName(
        docs.select((-1 - F.col("doc_id")).alias("doc_id"), X.tokenize(F.concat(F.lit("give help via "), "lang")).alias("t"))
    )
    return rows.select("doc_id", F.array_join(X.what_tokens(F.col("t")), " ").alias("tokens"))


# RE2 has no look-around: mark each sentence start, then split at the mark.
CLAUSES_SQL = (
    "list_filter(list_transform(flatten(list_transform("
    "list_transform(string_split_regex(regexp_replace(regexp_replace({c}, '\\n[" + Q.SPACE + "]*\\n', chr(1), 'g'), "
    "'([.!?])[" + Q.SPACE + "]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    "lambda s: " + Q.strip("s") + "), "
    "lambda s: string_split_regex(s, '[;—–][" + Q.SPACE + "]*|,[" + Q.SPACE + "]+(?:and|but|so|or|because|which|where|who|although)[" + Q.SPACE + "]+'))), "
    "lambda s: " + Q.strip("s") + "), lambda s: length(s) > 5)"
)


@query("p15_clauses", f"""
SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS clause
FROM (SELECT doc_id, {CLAUSES_SQL.replace('{c}', 'text')} AS c FROM documents)
""")
def p15(t):
    return t.documents.select("doc_id", F.posexplode(X.clauses(F.col("text"))).alias("pos", "clause")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def event_call():
    """A call string per event: ``click(k=69, page='click.txt')``."""
    k = F.get_json_object("props", "$.k")
    return F.concat("event_type", F.lit("(k="), k, F.lit(", page='"), "event_type", F.lit(".txt', user='u"), F.col("user_id"), F.lit("')"))


EVENT_CALL = "event_type || '(k=' || json_extract_string(props, '$.k') || ', page=''' || event_type || '.txt'', user=''u' || user_id || ''')'"


@query("p16_call_name", f"""
SELECT event_id, CASE WHEN regexp_extract(c, '^(\\w+)\\(', 1) <> '' THEN regexp_extract(c, '^(\\w+)\\(', 1) ELSE c END AS name,
  trim(split_part(c, '(', 1)) AS head
FROM (SELECT event_id, CASE WHEN value > 20 THEN props ELSE {EVENT_CALL} END AS c FROM events)
""")
def p16(t):
    call = F.when(F.col("value") > 20, F.col("props")).otherwise(event_call())
    return t.events.select("event_id", C.call_name(call).alias("name"), C.call_head(call).alias("head"))


@query("p17_call_args", """
SELECT event_id, '3' AS n, json_extract_string(props, '$.k') AS k, event_type || '.txt' AS page, 'u' || user_id AS user_arg FROM events
""")
def p17(t):
    args = t.events.select("event_id", C.call_args(event_call()).alias("a"))
    return args.select(
        "event_id",
        F.size(F.map_keys("a")).cast("string").alias("n"),
        F.col("a")["k"].alias("k"), F.col("a")["page"].alias("page"), F.col("a")["user"].alias("user_arg"),
    )


@query("p18_format_call", """
SELECT l_orderkey, l_linenumber, 'ship(flag=''' || l_returnflag || ''', status=''' || l_linestatus || ''', part=' || l_partkey || ', qty=' || CAST(l_quantity AS BIGINT) || ')' AS call,
 'ping()' AS empty_call
FROM lineitem
""")
def p18(t):
    strings = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    plain = F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("qty"), F.col("l_quantity").cast("bigint").cast("string"))
    none = F.create_map().cast("map<string,string>")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", C.format_call(F.lit("ship"), strings, plain).alias("call"),
        C.format_call(F.lit("ping"), none, none).alias("empty_call"),
    )


_RAW_TYPES = ["integer", "number", "float", "string", "boolean", "bool", "array", "list", "dict", "object", "tuple", "any", "uuid"]


@query("p19_normal_type", f"""
SELECT o_orderkey, coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in W.TYPE_NAMES.items())}}}, raw)[1], 'string') AS type_name,
  coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in W.TYPE_NAMES.items())}}}, item)[1], 'string') AS item_type
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {Q.words_list(_RAW_TYPES)}[1 + o_custkey % 13] END AS raw,
      {Q.words_list(_RAW_TYPES)}[1 + o_orderkey % 13] AS item FROM orders)
""")
def p19(t):
    names = F.array(*[F.lit(n) for n in _RAW_TYPES])
    raw = F.when(F.col("o_orderstatus") != "P", F.get(names, (F.col("o_custkey") % 13).cast("int")))
    item = F.get(names, (F.col("o_orderkey") % 13).cast("int"))
    return t.orders.select("o_orderkey", S.normal_type(raw).alias("type_name"), S.normal_type(item).alias("item_type"))


_NORMAL = f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in W.TYPE_NAMES.items())}}}"


@query("p19_nested_types", f"""
WITH r AS (SELECT o_orderkey, {Q.words_list(_RAW_TYPES)}[1 + o_custkey % 13] AS raw, {Q.words_list(_RAW_TYPES)}[1 + o_orderkey % 13] AS item FROM orders),
n AS (SELECT o_orderkey, coalesce(map_extract({_NORMAL}, raw)[1], 'string') AS raw, coalesce(map_extract({_NORMAL}, item)[1], 'string') AS item FROM r)
SELECT o_orderkey, 'a' AS path, raw AS type_name FROM n UNION ALL SELECT o_orderkey, 'd', 'array' FROM n UNION ALL SELECT o_orderkey, 'd.items', item FROM n
UNION ALL SELECT o_orderkey, 'a.b', item FROM n WHERE raw IN ('array', 'object') UNION ALL SELECT o_orderkey, 'a.c', 'string' FROM n WHERE raw IN ('array', 'object')
UNION ALL SELECT o_orderkey, 'a.b.x', raw FROM n WHERE raw IN ('array', 'object') AND item IN ('array', 'object')
""")
def p19_nested(t):
    names = F.array(*[F.lit(n) for n in _RAW_TYPES])
    raw, item = (F.get(names, (F.col(c) % 13).cast("int")) for c in ("o_custkey", "o_orderkey"))
    spec = F.format_string(
        '{"a":{"type":"%1$s","properties":{"b":{"type":"%2$s","properties":{"x":{"type":"%1$s"}}},"c":{}}},"d":{"type":"list","items":{"type":"%2$s"}}}', raw, item)
    return S.nested_types(t.orders.select("o_orderkey", spec.alias("spec")), "o_orderkey", "spec")


@query("p20_name_surgery", """
SELECT 's' || s_suppkey AS key, s_name || '.n' || s_nationkey AS full_name, 'n' || s_nationkey AS bare, s_name AS class_name,
  s_name AS base, s_name || '.get' AS qualified, s_name || '.x' AS dotted FROM supplier
UNION ALL
SELECT 'p' || p_partkey, p_brand, p_brand, '', p_brand, p_type || '.' || p_brand, p_brand || '.x' FROM part
""")
def p20(t):
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.concat("s_name", F.lit(".n"), "s_nationkey").alias("full_name"),
                          F.concat("s_name", F.lit("__v"), "s_nationkey", F.lit("__v1")).alias("v"), F.col("s_name").alias("cls"), F.lit("get").alias("short"), F.col("s_name").alias("n"))
    p = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_brand").alias("full_name"),
                      F.concat("p_brand", F.lit("__v"), "p_size").alias("v"), F.col("p_type").alias("cls"), F.col("p_brand").alias("short"), F.col("p_brand").alias("n"))
    f = F.col("full_name")
    return s.unionByName(p).select(
        "key", f, C.bare_name(f).alias("bare"), C.class_name(f).alias("class_name"), C.unvariant(F.col("v")).alias("base"),
        C.qualify(F.col("cls"), F.col("short")).alias("qualified"),
        C.restore_dotted(F.concat("n", F.lit("_x")), F.concat("n", F.lit(".x"))).alias("dotted"),
    )


@query("p21_comparable", f"SELECT doc_id, {Q.strip(f'regexp_replace(lower(text), {chr(39)}[^a-z0-9_{Q.SPACE}]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS plain FROM documents")
def p21(t):
    return t.documents.select("doc_id", X.comparable(F.col("text")).alias("plain"))


@query("p22_coerce", """
WITH a AS (
 SELECT event_id, 'k' AS param, 'integer' AS type_name, json_extract_string(props, '$.k') AS raw FROM events
 UNION ALL SELECT event_id, 'kind', 'integer', event_type FROM events
 UNION ALL SELECT event_id, 'score', 'float', CAST(user_id AS VARCHAR) || '.25' FROM events
 UNION ALL SELECT event_id, 'tags', 'array', event_type FROM events
 UNION ALL SELECT event_id, 'flag', 'boolean', event_type FROM events)
SELECT event_id, param, CASE WHEN type_name = 'integer' THEN coalesce(CAST(TRY_CAST(raw AS BIGINT) AS VARCHAR), raw)
  WHEN type_name = 'float' THEN coalesce(CAST(TRY_CAST(raw AS DOUBLE) AS VARCHAR), raw)
  WHEN type_name = 'boolean' THEN 'true' WHEN type_name = 'array' THEN '["' || raw || '"]' ELSE raw END AS typed FROM a
""")
def p22(t):
    args = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"),
        F.lit("score"), F.concat(F.col("user_id").cast("string"), F.lit(".25")), F.lit("tags"), F.col("event_type"),
        F.lit("flag"), F.col("event_type"), F.lit("unknown"), F.col("event_type"),
    )
    kinds = F.create_map(*[F.lit(x) for x in ("k", "integer", "kind", "integer", "score", "float", "tags", "array", "flag", "boolean")])
    rows = t.events.select("event_id", F.explode(args).alias("param", "raw")).withColumn("type_name", F.try_element_at(kinds, F.col("param")))
    # A parameter outside the schema is dropped.
    return rows.where("type_name is not null").select("event_id", "param", S.coerce(F.col("raw"), F.col("type_name")).alias("typed"))


@query("p23_parse_calls", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_calls,
  CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k') END AS first_arg FROM events
""")
def p23(t):
    answer = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), "props"))
        .when(F.col("event_type") == "view", F.concat(F.lit("```json\n["), "props", F.lit(","), "props", F.lit("]\n```")))
        .otherwise(F.concat(F.lit("```\n"), "props", F.lit("\n```")))
    )
    calls = t.events.select("event_id", C.parse_calls(answer).alias("c"))
    return calls.select("event_id", F.size("c").alias("n_calls"), F.get("c", F.lit(0))["k"].alias("first_arg"))
