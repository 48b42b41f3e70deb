"""Personal data, the trie of conversations, and the manifest."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, collected
from wayfind.llm import merkle, personal_data, places, prefix_trie, queries

# personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(text):
    """The four kinds by their patterns as they are written down."""
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = [
        ("email", EMAIL, lambda t: True),
        ("ip", IP, lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", CARD, lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", PHONE, lambda t: 8 <= len(digits(t)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in rules for m in re.finditer(p, text) if good(m.group())]


def base_of(text):
    return [(s.kind, s.start, s.end) for s in personal_data.spans_of(text) if s.kind in personal_data.BASE]


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text("0159.-+ ()@aZ_é\n", max_size=60),
    st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "1.2.3.4", "256.1.1.1", "a@b.c", "@", ".", " ", "x", "é", "5", "-"]), max_size=12).map("".join),
))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base_of(text) == plain_base(text)


def test_validators_and_words_nearby():
    kinds = lambda t: [(s.kind, t[s.start:s.end], s.score) for s in personal_data.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 und mehr") == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert kinds("see GB82WEST12345698765432 OK") == [("iban", "GB82WEST12345698765432", 0.8)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01") == []
    assert kinds("number 378282246310005 here") == [] and kinds("amex card 378282246310005") == [("short_card", "378282246310005", 0.8)]
    assert kinds("order 123-45-6789") == [] and kinds("social security 123-45-6789") == [("national_id", "123-45-6789", 0.9)]
    assert kinds("ssn 000-45-6789") == [] == kinds("pages (030) 1234 5678")
    assert kinds("Tel. (030) 1234 5678, bis dann") == [("local_phone", "(030) 1234 5678", 0.7)]
    assert kinds("phone +49 (030) 1234-5678") == [("phone", "+49 (030) 1234-5678", 0.95)]
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    assert personal_data.mod97("DE89370400440532013000") and not personal_data.mod97("DE88370400440532013000")


@pytest.mark.parametrize("long", ["9" * 400_000, "a" * 400_000, "1.2." * 100_000, "+1 " * 100_000, "a@" * 200_000, "AB12 " * 100_000, "1 " * 200_000])
def test_very_long_runs_are_read_in_one_go(long):
    assert base_of(long) == [] or long.startswith("1.2.") and len(base_of(long)) == 50_000


def test_personal_data_query_of_awkward_rows(spark, tmp_path):
    docs = awkward(spark).unionByName(awkward(spark, [(20, "mail a@b.co, \U0001f600 4111 1111 1111 1111", "en"), (21, "Tel. (030) 1234 5678", None)]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = collected(queries.op11_personal_data(spark, str(tmp_path)))
    texts = defaultdict(list)
    for r in collected(docs):
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(found) == docs.count()
    for r in found:
        wants = [plain_base(t) for t in texts[r["doc_id"]]]
        digest = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in w).encode()).hexdigest() for w in wants]
        assert r["base_sha256"] in digest
        want = wants[digest.index(r["base_sha256"])]
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(w[0] == k for w in want) for k in personal_data.BASE]
    by = {r["doc_id"]: r["spans"] for r in found}
    assert by[20] == "email:5:11,card:15:34" and by[21] == "local_phone:5:20" and by[5] == ""
    hidden = {r["doc_id"]: r["text"] for r in collected(personal_data.redacted(docs))}
    assert hidden[20] == "mail [email], \U0001f600 [card]" and hidden[4] is None and personal_data.redacted(docs).columns == docs.columns
    assert personal_data.with_spans(docs.limit(0)).count() == 0


def test_all_documents_against_the_plain_patterns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in collected(queries.documents(spark, folder).select("doc_id", "text"))}
    for r in collected(queries.op11_personal_data(spark, folder)):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


# places

def test_places_of_a_hot_key(spark):
    rows = [(0 if k % 3 else k, (k * 7919) % 500 if k % 11 else None, k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "key bigint, at bigint, tag bigint").repartition(7)
    found = collected(places.placed(df, "key", ["at"], "place"))
    by = defaultdict(list)
    for r in found:
        by[r["key"]].append((r["place"], -1 if r["at"] is None else r["at"]))
    for got in by.values():
        got.sort()
        assert [p for p, _ in got] == list(range(len(got))) and [a for _, a in got] == sorted(a for _, a in got)
    assert len(found) == len(rows) == len({r["tag"] for r in found})


# trie

def plain_trie(rows):
    """Every node from lists of whole beginnings."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, code, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        own_saving = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += own_saving
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string, id string, word string, pos bigint"


def turn_rows():
    rows = []
    for c in range(60):
        n = [0, 3, 12, 25, 7][c % 5] + c % 4
        rows += [(c, k, "user" if k % 2 else "assistant", f"t{(c // 10) % 3}-{k if k < 9 else k % 2}é") for k in range(n)]
    rows += [(100, 0, None, None), (101, None, "user", "x"), (101, 0, "user", None), (101, 1, "user", "é" * 1_000), (102, 5, "a", "same"), (102, 5, "a", "same")]
    rows += [(200, k, "user", "again") for k in range(90)] + [(205, k, "user", "again") for k in range(90)] + [(210, k, "user", "again") for k in range(45)]
    return rows + [(None, 0, "user", "nobody's"), (None, None, None, None)]


@pytest.mark.parametrize(("segment", "words", "turns"), [(256, 20_000, 200_000), (256, 3, 10), (7, 2, 1_000), (1, 5, 40), (45, 1, 1)])
def test_trie_is_that_of_brute_force(spark, segment, words, turns):
    rows = turn_rows()
    df = spark.createDataFrame([(*r, "i", "w", 3) for r in rows], TURNS)
    found = collected(prefix_trie.conversation_trie(df, segment, words, turns))
    assert sorted((tuple(r.values()) for r in found), key=str) == plain_trie(rows)


def test_trie_of_no_turns_and_of_one(spark):
    df = spark.createDataFrame([(*r, "i", "w", 3) for r in turn_rows()], TURNS)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    alone = [(5, None, None, None)]
    one = collected(prefix_trie.conversation_trie(spark.createDataFrame([(*alone[0], "i", "w", 3)], TURNS)))
    assert sorted((tuple(r.values()) for r in one), key=str) == plain_trie(alone)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    rows = [("a" if k % 3 else f"b{k % 7}", k) for k in range(900)]
    found = {r["id"]: r["ends_sha256"] for r in collected(prefix_trie.joined_digests(spark.createDataFrame(rows, "id string, conv bigint").repartition(5)))}
    want = defaultdict(list)
    for i, c in rows:
        want[i].append(c)
    assert found == {i: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for i, c in want.items()}


def test_ternary_tree_is_balanced_and_whole():
    words = [[k] for k in range(1_000)]
    tree = prefix_trie.TernaryTree(words)
    deepest, open_ = 0, [(tree.top, 1)]
    while open_:
        at, level = open_.pop()
        if at >= 0:
            deepest = max(deepest, level)
            open_ += [(tree.low[at], level + 1), (tree.high[at], level + 1)]
    assert deepest <= 10 and len(tree.walk()) == 1_000
    assert all(tree.code[tree.find(-1, k)] == k for k in range(1_000)) and tree.find(-1, 1_000) == -1


# manifest

def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    seal = lambda *v: hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v).encode()).hexdigest()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def reduce(nodes):
        sides = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                first = a - a % 16
                run = nodes[first:first + 16]
                sides[k].append(("".join(run[:a - first]), "".join(run[a - first + 1:])))
            nodes = [h("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
            at = [a // 16 for a in at]
        return nodes[0], sides

    groups = defaultdict(list)
    for r in rows:
        changed = seal(*r[:4], r[4] and r[4].translate({c: c + 32 for c in range(65, 91)}))
        groups[r[1]].append(((r[0] is not None, r[0] or 0, seal(*r)), r[0], changed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for name in names:
        groups[name].sort()
        subs.append(reduce([g[0][2] for g in groups[name]]))
    root, outer = reduce([s[0] for s in subs])
    out = []
    for (sub, inner), name, upper in zip(subs, names, outer):
        for ((_, _, leaf), doc, changed), sides in zip(groups[name], inner):
            x = changed if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else leaf
            for a, b in sides + upper:
                x = h(a + x + b)
            out.append((doc, leaf, sub, root, h("".join(a + b for a, b in sides + upper)), x, x == root))
    return sorted(out, key=str)


def leaves_of(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.sealed(*fields[:-1], lowered))
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), merkle.sealed(*fields).alias("leaf"), changed.alias("changed"))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_that_of_brute_force(spark, levels):
    sizes = {"a": 1, "b": 16, "c": 17, "é": 256, "": 257, None: 300, "z": 800, **{f"s{k}": 1 for k in range(40)}}
    rows = [(k if k % 50 else None, s, "en" if k % 3 else None, k % 9, None if k % 13 == 0 else f"Text {k} É") for s, n in sizes.items() for k in range(n)]
    rows += [(5, "z", "en", 1, "Same Row")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = collected(merkle.manifest(leaves_of(docs), levels))
    assert sorted((tuple(r.values()) for r in found), key=str) == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "source" if "source" in r else "row", "lang", "n_chars", "text")) for r in collected(docs.withColumn("source", F.col("row")))]
    docs.withColumn("source", F.col("row")).withColumn("place", F.lit(1)).withColumn("key", F.lit("k")).write.parquet(f"{tmp_path}/more/documents.parquet")
    found = collected(queries.op13_merkle_manifest(spark, f"{tmp_path}/more"))
    assert sorted((tuple(r.values()) for r in found), key=str) == plain_manifest(rows)
    assert merkle.manifest(leaves_of(docs.withColumn("source", F.lit("x")).limit(0))).count() == 0


def test_versions_share_what_is_not_above_a_changed_leaf():
    tree = merkle.PersistentTree([merkle.digest(str(k)) for k in range(300)], 3)
    before = len(tree.digests)
    version = tree.put(17, merkle.digest("other"))
    assert len(tree.digests) == before + 4 and tree.digests[version] != tree.digests[tree.root]
    old, new = tree.children[tree.root], tree.children[version]
    assert [a == b for a, b in zip(old, new)].count(False) == 1
    rebuilt = merkle.PersistentTree([merkle.digest("other" if k == 17 else str(k)) for k in range(300)], 3)
    assert rebuilt.digests[rebuilt.root] == tree.digests[version] == merkle.fold(merkle.digest("other"), tree.sides(17))
    second = tree.put(290, merkle.digest("x"), version)
    assert tree.path(17, second)[-1][0] == tree.path(17, version)[-1][0]
