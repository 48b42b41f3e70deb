"""Exact copies, near copies, repeated passages and fingerprints."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.llm.helpers import awkward, collected, prose
from wayfind.llm import dart_minhash, exact_dedup, fingerprints, queries, suffix_dedup

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    problem, n = compare(spark, duck(FOLDER), FOLDER, name, queries.QUERIES[name], queries.SQL[name])
    assert problem is None and n


# exact

def test_filters_merge_without_loss():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 64, size=500, dtype=np.uint64) for _ in range(4)]
    parts += [parts[0][:100], parts[0][50:70]]
    whole = exact_dedup.CountingQuotientFilter.of(np.zeros(0, np.uint64), 12)
    for p in parts:
        f = exact_dedup.CountingQuotientFilter.of(p, 12)
        whole = whole.merge(exact_dedup.CountingQuotientFilter.from_row(12, f.to_row()))
    value, count = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == value).all() and (whole.counts == count).all()
    low = whole.shard(0, 1 << 11)
    high = whole.shard(1 << 11, 1 << 12)
    assert (np.concatenate([low.fingerprints(), high.fingerprints()]) == value).all()


def test_exact_groups_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = collected(docs.select("doc_id", "text"))
    found = collected(exact_dedup.exact_groups(docs))
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r.values()) for r in found), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in collected(kept)) == sorted(groups)
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


# near

def brute_classes(rows):
    sets = [dart_minhash.numbered(t or "") for _, t in rows]
    low = -(1 << 63)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or dart_minhash.jaccard(sets[a], sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[find(k)].append(low if i is None else i)
    back = lambda i: None if i == low else i
    return sorted(((back(i), back(min(c)), len(c)) for c in classes.values() for i in c), key=str)


def mutated(base: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randint(0, 10**6)}" for w in base.split())


@pytest.mark.parametrize("block", [1_000, 7])
def test_near_classes_are_those_of_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", block)
    bases = [prose(n, 50 + n) for n in (12, 40, 150, 300)]
    rows = [(k * 100 + j, mutated(b, 0.03 * (j % 4) / 2, j)) for k, b in enumerate(bases) for j in range(25)]
    rows += [(900, None), (901, ""), (902, "one"), (903, "one"), (904, "one two"), (905, prose(80, 9) + " " + bases[1])]
    found = collected(dart_minhash.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=str) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_near_classes_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in collected(docs.select("doc_id", "text"))]
    found = collected(dart_minhash.near_classes(docs))
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=str) == brute_classes(rows)
    assert dart_minhash.near_classes(docs.limit(0)).count() == 0
    kept = dart_minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in collected(kept)) == [-1, -1, 1, 7, 8, 8, 9, 10, 11]


def test_slices_of_texts_without_a_word(spark):
    rows = [(1, prose(30, 1)), (2, None), (3, "x " * 300_000), (4, ""), (5, prose(30, 1) + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (docs.coalesce(1), docs.repartition(5, "doc_id"), docs.where("doc_id in (2, 4)")):
        found = collected(dart_minhash.near_classes(parts))
        assert len(found) == parts.count() and {r["class_id"] for r in found if r["doc_id"] in (2, 4)} == {2}


@pytest.mark.parametrize("name", ["_was_null", "_WAS_NULL", "a.b", "row.kept"])
def test_columns_of_any_name_come_back(spark, name):
    rows = [(1, prose(60, 1), 7), (2, prose(60, 1) + " " + prose(20, 2), 8), (3, None, None), (4, prose(60, 1), 9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", name])
    for kept in (exact_dedup.keep_one(docs), suffix_dedup.without_repeats(docs)):
        assert kept.columns == docs.columns
        by = {r[0]: (r[1], r[2]) for r in kept.collect()}
        assert by[3] == (None, None) and by[4][1] == 9 and by[2][1] == 8
    cut = {r[0]: r[1] for r in suffix_dedup.without_repeats(docs).collect()}
    assert cut[4] == "" and len(cut[2]) < len(rows[1][1]) and cut[1] == rows[0][1]


def test_one_id_with_several_texts(spark):
    rows = [(1, prose(300, 1)), (1, prose(300, 2)), (2, prose(300, 1)), (3, mutated(prose(300, 2), 0.01, 1))]
    found = collected(dart_minhash.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_signatures_estimate_weighted_similarity():
    a, b = prose(300, 1), mutated(prose(300, 1), 0.03, 2)
    a, b = a + " kan lora miti rus teta" * 6, b + " kan lora miti rus teta" * 2
    exact = dart_minhash.jaccard(dart_minhash.numbered(a), dart_minhash.numbered(b))
    hits = [(lambda s: (s[0] == s[1]).mean())(dart_minhash.signatures([a, b], 128, seed)) for seed in range(40)]
    assert abs(np.mean(hits) - exact) < 0.02
    element, weight = np.array([5, 9], np.uint64), np.array([0.3, 2.5])
    one = dart_minhash.sketches(np.zeros(2, int), element, weight, 1)
    other = dart_minhash.sketches(np.zeros(2, int), element, 1.5 * weight, 1)
    assert 0.5 < (one == other).mean() < 0.85  # the similarity is 2 / 3


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102)], "a bigint, b bigint")
    found = dict(dart_minhash.components(links).collect())
    assert {v for k, v in found.items() if k <= 40} == {0} and {found[k] for k in (100, 101, 102)} == {100}


# passages

def brute_cut(rows):
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mine = (1 << 63) - 1 if i is None else i
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            s = raw[p:p + 50]
            if any(((1 << 63) - 1 if j is None else j) < mine and s in (u or "").encode() for j, u in rows):
                gone[p:p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def cut(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collected(suffix_dedup.remove_repeats(docs))), key=str)


def test_passages_as_brute_force(spark):
    passage, other = prose(15, 1), "éñ" * 40
    rows = [
        (5, prose(10, 2) + passage + prose(10, 3)), (3, passage), (9, prose(8, 4) + passage[5:70]), (8, passage + passage),
        (7, "ab" * 60), (6, "ab" * 40 + "c"), (2, "x" * 49), (1, "x" * 49), (4, "x" * 50), (10, "x" * 200), (11, other + passage[:60]),
        (12, "q" + other), (13, None), (14, ""), (14, passage), (14, passage), (None, passage), (None, prose(30, 8)), (15, prose(10, 3)[10:60]), (16, prose(10, 3)[10:59]),
    ]
    assert cut(spark, rows) == brute_cut(rows)


def test_random_passages_as_brute_force(spark):
    r = random.Random(4)
    pool = "".join(r.choice("abc ") for _ in range(400))
    rows = []
    for k in range(60):
        text = ""
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, 330)
            text += pool[a:a + r.randint(20, 70)] if r.random() < 0.7 else "".join(r.choice("abcdef ") for _ in range(r.randint(1, 60)))
        rows.append((r.randint(0, 40), text))
    assert cut(spark, rows) == brute_cut(rows)


def test_passages_where_a_task_has_rows_for_few_shards(spark, monkeypatch):
    assert len(suffix_dedup._unplaned(suffix_dedup._planes(np.zeros(0, np.int64)), np.int64)) == 0
    monkeypatch.setattr(suffix_dedup, "SHARD_STRETCHES", 0.1)
    passage = prose(15, 1)
    rows = [(k, prose(10, 10 + k) + passage[k:] + prose(10, 30 + k)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collected(suffix_dedup.remove_repeats(docs))]
    assert sorted(out, key=str) == brute_cut(rows)


def test_levels_are_like_one_scan():
    r = np.random.default_rng(2)
    family = suffix_dedup.LevelFamily()
    runs, marked = [], []
    for _ in range(20):
        n = int(r.integers(1, 60))
        run = (r.integers(0, 200, n).astype(np.uint64), r.integers(0, 50, n).astype(np.uint32), np.zeros(n, np.uint16), r.integers(0, 30, n))
        runs.append(run)
        first, doc, name = suffix_dedup.first_of_each(run)
        marked += list(zip(doc, name))
        marked += list(zip(*family.add(first)))
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    name, doc = np.concatenate([x[0] for x in runs]), np.concatenate([x[3] for x in runs])
    least = {n: doc[name == n].min() for n in set(name)}
    assert {(int(d), int(n)) for d, n in marked} == {(int(d), int(n)) for d, n in zip(doc, name) if d > least[n]}


def test_passages_of_awkward_rows(spark):
    docs = awkward(spark)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in collected(kept)}
    assert by[2] == "" and by[4] is None and by[13] == "" and by[3] == docs.where("doc_id = 3").first().text[len(by[1]):]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# fingerprints

def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows_per_task", [20_000, 3])
def test_edited_texts(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(fingerprints, "TASK_ROWS", rows_per_task)
    rows = [(k * 3 % 41, prose(5 + 7 * k % 90, k)) for k in range(40)] + [(50, None), (51, ""), (52, "\U0001f600éx"), (53, prose(20_000, 3))]
    found = collected(fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == edited(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark)
    found = collected(fingerprints.edited_fingerprints(docs))
    assert len(found) == docs.count()
    by = defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] and by[7] == by[13] and by[4] == by[5] == by[6] and by[1] != by[3]
    assert len({f for s in by.values() for f in s}) == len({r.text or "" for r in docs.select("text").collect()})
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    one = collected(fingerprints.edited_fingerprints(docs.where("doc_id = 1")))
    assert one[0]["near_next"] == 1.0


def plain_fingerprint(text):
    """The same from its definition: no sorting tricks, every start looked at by itself."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hash_of = lambda raw, seed=42: xxhash.xxh64_intdigest(raw, seed)
    long_hash = lambda x, seed=42: hash_of((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    padded = "\x01" * 9 + text
    own = [hash_of(padded[k:k + 10].encode()) for k in range(len(text))] if text else [hash_of(b"")]
    part, n = 1 << 59, len(own)
    near = part if n <= 32 * 24 else int(float(part * 32 * 24) / n)
    seen, numbers = defaultdict(int), []
    for place, h in enumerate(own):
        if h % part < near:
            cut = h >> 24
            seen[cut] += 1
            value = (cut << 24) | place
            if seen[cut] > 1:
                run = signed(cut << 24) >> 24
                value ^= (_pair(run, seen[cut] - 1, long_hash) & 31) << 59
            numbers.append(value)
    # numbers are compared as signed ones
    ordered = sorted(map(signed, numbers))
    out = []
    for seed in range(32):
        start = -(1 << 63) + seed * part
        after = [v for v in ordered if v >= start] + [v for v in ordered if v < start]
        places = sorted(v & (1 << 24) - 1 for v in (after * 2)[:2])  # a lone run counts twice
        h = 42
        for p in places:
            h = long_hash(own[p], h)
        out.append(h)
    return "".join(f"{h:016x}" for h in out)


def _pair(run, number, long_hash):
    return xxhash.xxh64_intdigest((number & (1 << 32) - 1).to_bytes(4, "little"), long_hash(run))


def test_fingerprints_are_those_of_their_definition(spark):
    texts = ["", "a", "abc", "a" * 50, prose(40, 1), prose(300, 2), "na " * 400, prose(900, 3), "\U0001f600日本 " * 90, "x" * 3_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in collected(fingerprints.edited_fingerprints(docs))}
    for k, text in enumerate(texts):
        following = texts[k - 1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed = plain_fingerprint(text), plain_fingerprint(edited)
        assert found[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[k]["fingerprint"] == own, k
        assert found[k]["edited_fingerprint"] == changed, k
        alike = lambda a, b: sum(a[i:i + 16] == b[i:i + 16] for i in range(0, len(a), 16)) / 32
        assert found[k]["near_edited"] == alike(own, changed) and found[k]["near_next"] == alike(own, plain_fingerprint(following))


def test_runs_of_edited_texts(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ab \U0001f600é") for _ in range(n))
    rows = [(word(n), word(m)) for n in (0, 1, 2, 5, 9, 10, 17, 18, 19, 20, 40) for m in (0, 1, 4, 8, 9, 10, 30)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("n", F.length("a")).withColumn("h", F.floor(F.col("n") / 2).cast("int"))
    df = df.withColumn("own", fingerprints.runs(F.col("a")))
    edited = F.concat(F.expr("substring(a, 1, n - h)"), F.expr("substring(b, 1, h)"))
    both = df.select(fingerprints.edited_runs(F.col("a"), F.col("b"), F.col("own"), F.col("n"), F.col("h")).alias("x"), fingerprints.runs(edited).alias("y"))
    assert all(r.x == r.y for r in both.collect())


def test_a_hot_id_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "TASK_ROWS", 5)
    rows = [(7, prose(4, k)) for k in range(60)] + [(k, prose(4, 100 + k)) for k in range(30)] + [(None, prose(4, 200 + k)) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    placed, _ = fingerprints.with_next(docs, "doc_id", "text")
    assert placed.groupBy("bucket", "piece").count().agg(F.max("count")).first()[0] < 20
    found = collected(placed.where("ghost = 0").select("id", "body", "next_body", "tie"))
    order = sorted(found, key=lambda r: (r["id"] is None, -(r["id"] or 0), -r["tie"]))
    assert [r["next_body"] for r in order] == [r["body"] for r in order[1:] + order[:1]]


def test_likeness_falls_with_edits_and_with_moves(spark):
    words = prose(400, 6).split()
    moved = words[200:] + words[:200]
    mixed = [w for k in range(0, 400, 10) for w in words[390 - k:400 - k]]
    texts = [words, words[:380] + prose(20, 1).split(), words[:200] + prose(200, 2).split(), moved, mixed, prose(400, 3).split()]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "k int, text string")
    df = fingerprints.with_fingerprint(df, F.col("text"), "f")
    a, b = df.select("f").where("k = 0"), df.select("k", F.col("f").alias("g"))
    near = dict(b.crossJoin(a).select("k", fingerprints.likeness(F.col("f"), F.col("g"))).collect())
    assert near[0] == 1.0 > near[1] > near[2] > near[5] == 0.0
    assert near[4] < near[3] < 1.0  # the same words in another order


@pytest.mark.parametrize("before,after", [
    ("kan lora miti tes shalem ond kavo lon", "kan lora miti tes shalem rud tera"),  # eight words, and seven
    (prose(9, 11), " ".join(prose(9, 11).split()[:5] + prose(4, 12).split())),
    ("今日は天気がいいので散歩に行きました。", "今日は天気がいいので家で本を読みます。"),
    ("日本語 " * 9 + "今日は天気がいい", "日本語 " * 6 + "今日は天気がいい"),
    ("abcdef", "abcdez"),
])
def test_short_and_unspaced_texts_share_runs(spark, before, after):
    one = spark.createDataFrame([(before, after)], "a string, b string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(one, F.col("a"), "f"), F.col("b"), "g")
    assert 0.0 < both.select(fingerprints.likeness(F.col("f"), F.col("g"))).first()[0] < 1.0


def test_runs_take_whole_code_points(spark):
    one = spark.createDataFrame([("\U0001f600é\n" * 20,), ("",), ("x",)], "t string")
    assert [len(r[0]) for r in one.select(fingerprints.runs(F.col("t"))).collect()] == [60, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=130), max_size=6))
def test_stretches_cover_every_string_once(texts):
    raw = [t.encode() for t in texts]
    s, begins = suffix_dedup.stretches(raw)
    places, which = suffix_dedup._spread(s.first, s.last)
    want = [b + k for b, t in zip(begins, raw) for k in range(len(t) - 49)]
    assert sorted(places.tolist()) == want
    by = {}
    data = b"".join(raw)
    for f, last, name in zip(s.first, s.last, s.name):
        assert by.setdefault(int(name), data[f:last + 50]) == data[f:last + 50]
