"""Packing, the piece codec, tool calls and the pipeline."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, collected, prose
from wayfind.llm import packing, piece_codec, tool_calls

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=40), st.integers(1, 9))
def test_every_token_is_packed_once(sizes, segments):
    length = 128
    sequences = packing.pack(sizes, length, segments)
    seen = {k: [] for k in range(len(sizes))}
    for s in sequences:
        held = sum(p.length for p in s)
        assert held == length or held & (held - 1) == 0
        assert len(s) <= segments
        for p in s:
            seen[p.doc].append((p.start, p.length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == size


def test_loss_tokens_are_limited_too():
    r = random.Random(1)
    bears = {k: [r.random() < 0.4 for _ in range(r.randint(1, 300))] for k in range(60)}
    loss_of = lambda d, s, n: sum(bears[d][s:s + n])
    sequences = packing.pack([len(b) for b in bears.values()], 128, 6, 40, loss_of)
    assert all(sum(loss_of(p.doc, p.start, p.length) for p in s) <= 40 for s in sequences)
    assert sum(p.length for s in sequences for p in s) == sum(map(len, bears.values()))


def test_dot_product_prefers_the_fitting_room():
    pieces = [packing.Piece(0, 0, 60, 10), packing.Piece(1, 0, 50, 50), packing.Piece(2, 0, 40, 8)]
    bins = packing.place(pieces, 100, 10, 60)
    assert [sorted(p.doc for p in b) for b in bins] == [[0, 2], [1]]


def test_packed_awkward_rows(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark)
    t = Tokenizer.from_file(WORDS)
    want = sorted(json.dumps([r["doc_id"], len(i := [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(i, "<u4").tobytes())])
                  for r in collected(docs))
    rows = collected(packing.packed(docs.coalesce(1), WORDS))
    assert sum(r["length"] for r in rows) == sum(json.loads(w)[1] for w in want)
    single = [json.dumps([r["doc_id"], r["doc_tokens"], r["ids_crc32"]]) for r in rows if r["length"] == r["doc_tokens"]]
    assert single and set(single) <= set(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert packing.packed(docs.limit(0), WORDS).count() == 0


def test_answers_bear_loss_up_to_a_limit(spark):
    rows = [(k, prose(20 + k, k), None if k % 7 == 0 else prose(10 + 5 * k % 90, 99 + k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, answer string").coalesce(1)
    words = packing.tokens_of(WORDS)
    sizes = {k: (len(words.encode(t)) // 4, len(words.encode(a or "")) // 4 + 1) for k, t, a in rows}
    for loss, length in ((48, 256), (256, 256), (1, 64)):
        found = collected(packing.packed(docs, WORDS, length=length, segments=5, answer_col="answer", loss=loss))
        by, cover = {}, {}
        for r in found:
            by.setdefault(r["sequence_id"], []).append(r)
            cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            prompt = sizes[r["doc_id"]][0]
            assert r["loss_tokens"] == sum(at >= prompt for at in range(r["start"], r["start"] + r["length"]))
        assert all(sum(r["loss_tokens"] for r in s) <= loss and len(s) <= 5 and sum(r["length"] for r in s) <= length for s in by.values())
        for k, (prompt, answer) in sizes.items():
            at = 0
            for start, n in sorted(cover[k]):
                assert start == at
                at += n
            assert at == prompt + answer
    assert "loss_tokens" not in packing.packed(docs, WORDS).columns


PARTS = ["a", "The", " ", "  ", "\n", "\t", "don't", "B.", "..", "x,", "É", "Σ", "İ", "ß", "\x01", "\x1c", "日本", "<|endoftext|>", "12.", "▁", "\U0001f600", "\x00", "</s>", "<0x0A>", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_word_tokens_as_the_tokenizer(text):
    words = packing.tokens_of(WORDS)
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=30)))
def test_pieces_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    codec = piece_codec.model_of(PIECES)
    ids = [*codec.library.encode(text), codec.library.eos_id()]
    shown = codec.library.decode(ids)
    assert codec.encode(text) == ids and codec.decode(ids).decode() == shown
    digest = codec.digest(text)
    assert digest == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_coded_awkward_rows(spark):
    docs = awkward(spark)
    library = piece_codec.model_of(PIECES).library
    found = collected(piece_codec.encoded_digests(docs, PIECES))
    want = []
    for r in collected(docs):
        ids = [*library.encode(r["text"] or ""), library.eos_id()]
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r.values()) for r in found), key=str) == sorted(want, key=str)
    round_trip = collected(piece_codec.encoded(docs, PIECES))
    assert sorted(r["decoded"] for r in round_trip) == sorted(r["text"] or "" for r in collected(docs))
    assert piece_codec.encoded_digests(docs.limit(0), PIECES).count() == 0


# tool calls

CALLS = "conv bigint, id string, pos bigint, name string, arguments string, after array<string>, content string, errors string"
SCHEMAS = [("f", "x", "integer", True), ("f", "y", "string", False), ("g", None, None, None)]


def linked(spark, calls, results, schemas=SCHEMAS):
    rows = collected(tool_calls.linked_calls(
        spark.createDataFrame([(*c, "own", "own") for c in calls], CALLS),
        spark.createDataFrame(results, "conv bigint, id string, content string, name string"),
        spark.createDataFrame(schemas, "name string, param string, type string, required boolean"),
    ))
    return sorted(rows, key=lambda r: (str(r["conv"]), r["ordinal"] is None, r["ordinal"], str(r["id"])))


def test_calls_are_ordered_checked_and_linked(spark):
    calls = [
        (1, "a", 0, "f", '{"y":"q", "x":1}', ["c"]), (1, "b", 1, "f", '{"x":"1"}', None), (1, "c", 2, "g", "{}", ["d"]),
        (1, "d", 3, "g", '{"z":{"b":1,"a":[1, 2]}}', []), (2, "a", 0, "f", "{}", ["zz", "a"]), (2, "b", 1, "h", "{}", None),
        (2, "c", 2, "f", "[1]", None), (2, "d", 3, "f", None, None), (2, None, 4, "g", "{}", ["a"]),
        (3, "p", 0, "g", "{}", ["q"]), (3, "q", 1, "g", "{}", ["p"]), (3, "r", 2, "g", "{}", ["p"]), (3, "s", 3, "g", "{}", None), (3, "s", 3, "g", "{}", None),
        (None, "a", 0, "g", "{}", None),
    ]
    rows = linked(spark, calls, [(1, "a", "one", "x"), (1, "a", "uno", "x"), (1, "zz", "lost", "x"), (None, "a", None, "x")])
    errors = {(r["conv"], r["id"]): r["errors"] for r in rows}
    assert [r["id"] for r in rows if r["conv"] == 1] == ["b", "d", "c", "a", "zz"]
    assert errors[1, "a"] == [] and errors[1, "b"] == ["not integer x"] and errors[1, "d"] == ["unknown z"] and errors[1, "zz"] == ["no call"]
    assert errors[2, "a"] == ["missing x", "depends on itself", "unknown dependency zz"] and errors[2, "b"] == ["no such tool"]
    assert errors[2, "c"] == ["no object"] == errors[2, "d"] and errors[2, None] == ["no id"]
    assert errors[3, "p"] == ["depends on a cycle"] and errors[3, "s"] == ["repeated id"]
    by = {(r["conv"], r["id"]): r for r in rows}
    assert by[1, "a"]["message"] == '{"arguments":{"x":1,"y":"q"},"errors":[],"id":"a","name":"f","ordinal":3,"result":"one"}'
    assert '"arguments":{"z":{"a":[1,2],"b":1}}' in by[1, "d"]["message"]
    assert by[1, "zz"]["ordinal"] is None and not by[1, "zz"]["valid"] and by[None, "a"]["valid"]
    assert sum(r["conv"] == 3 for r in rows) == 5


def test_long_conversations_are_ordered_in_spans(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "SPAN", 8)
    calls = [(1, f"c{k:03d}", k, "g", "{}", [f"c{k + 1:03d}"] if k % 7 == 3 and k < 59 else None) for k in range(60)]
    rows = linked(spark, calls, [])
    place = {r["id"]: r["ordinal"] for r in rows}
    assert sorted(place.values()) == list(range(60))
    assert all(place[c[1]] > place[d] for c in calls for d in c[5] or [])


def test_repeated_results_keep_a_row_each(spark):
    results = [(1, "a", "y", "n"), (1, "a", "x", "n"), (1, "a", "x", "n"), (1, "a", None, "n"), (1, "z", "v", "n"), (1, "z", "w", "n"), (1, None, "s", "n"), (1, None, "t", "n")]
    calls = spark.createDataFrame([(1, "a", 0, "g", "{}", None, "own", "own")], CALLS)
    results = spark.createDataFrame(results, "conv bigint, id string, content string, name string")
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    rows = collected(tool_calls.linked_calls(calls, results, schemas, every_result=True))
    found = sorted((str(r["id"]), str(json.loads(r["message"])["result"]), -1 if r["ordinal"] is None else r["ordinal"], r["valid"], r["errors"]) for r in rows)
    assert [f[:2] for f in found] == [("None", "s"), ("None", "t"), ("a", "None"), ("a", "x"), ("a", "x"), ("a", "y"), ("z", "v"), ("z", "w")]
    assert [f[4] for f in found if f[0] != "a"] == [["no call"], ["no call"], ["no call"], ["repeated result"]]
    assert sorted(f[4] for f in found if f[0] == "a") == [[], *[["repeated result"]] * 3] and sum(f[3] for f in found) == 1


def test_no_calls_at_all(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tool_calls.linked_calls(*tool_calls.calls_of_conversations(turns)).count() == 0
    odd = spark.createDataFrame([(None, None, "user", None), (1, 0, None, "x"), (1, 1, "assistant", None), (2, 0, "user", "q" * 500_000)], turns.schema)
    rows = collected(tool_calls.linked_calls(*tool_calls.calls_of_conversations(odd)))
    assert len(rows) == 3


# pipeline

def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == before


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_awkward_rows(spark, empty, tmp_path):
    docs = awkward(spark)
    labels = spark.createDataFrame([(k, int(k != 12)) for k in range(1, 14)], "doc_id bigint, quality int")
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, here, str(tmp_path)).columns == here.columns
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() == 0) == empty
