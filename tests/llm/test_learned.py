"""Quality, toxicity and language models."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, collected, prose
from wayfind.llm import language_id, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.98), ("op2_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    found = queries.QUERIES[name](spark, FOLDER)
    rows = collected(found.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out"))
    p = np.array([r["score"] for r in rows])
    y = np.array([r[label] for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    order = np.concatenate([p[y == 1][:, None] - p[y == 0][None]])
    assert ((order > 0) + 0.5 * (order == 0)).mean() >= least
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_held_out_language(spark):
    rows = collected(queries.QUERIES["op3_language_id"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").where("held_out"))
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, score double")


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = labels_of(spark, [(1, 1, 0, 0.1), (1, 1, 0, 0.1), (3, 0, 1, 0.2), (12, 0, 1, 0.3), (None, 1, 1, 0.0), (9, None, None, 0.0)])
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        for known in (labels, labels.where("doc_id = 1"), labels.limit(0)):
            model = module.fit(docs, known, label_col=column)
            scores = [r[0] for r in docs.select(module.scorer(model)(F.col("text"))).collect()]
            assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        assert docs.limit(0).select(module.scorer(module.fit(docs.limit(0), labels, label_col=column))(F.col("text"))).count() == 0
        assert scores[3] == scores[4] == scores[5]  # null is empty


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    predict = language_id.predictor(language_id.fit(docs))
    rows = collected(docs.select("text", predict(F.col("text")).alias("r")))
    learned = {"en", "de", "fr", "es", "ja"}
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["r"]["lang_pred"] in learned) if letters else (r["r"] == {"lang_pred": "und", "score": 0.0})
    nothing = language_id.predictor(language_id.fit(docs.limit(0)))
    assert {r[0] for r in docs.select(nothing(F.col("text"))["lang_pred"]).collect()} == {"und"}


def test_forward_backward_sums_over_all_paths():
    random = np.random.default_rng(3)
    scores, transition, first = random.normal(size=(7, 3)), random.normal(size=(3, 3)), random.normal(size=3)
    starts, lengths = np.array([0, 4, 6]), np.array([4, 2, 1])
    found, _, _ = language_id.forward_backward(scores, starts, lengths, transition, first)
    for start, length in zip(starts, lengths):
        total, want = 0.0, np.zeros((length, 3))
        for path in itertools.product(range(3), repeat=int(length)):
            s = first[path[0]] + sum(scores[start + t][y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(s)
            for t, y in enumerate(path):
                want[t, y] += np.exp(s)
        assert np.allclose(found[start:start + length], want / total)


def test_words_of_a_switched_text_get_their_own_labels():
    spans = [("a", ["kalo", "miru", "tesha"]), ("b", ["zwip", "quox", "vylt"])] * 40
    model = language_id.train(spans)
    row, probability = model.label_words(["kalo tesha miru kalo zwip vylt quox zwip"])
    assert probability.argmax(axis=1).tolist() == [0] * 4 + [1] * 4
    assert model.transition[0, 0] > model.transition[0, 1]


def test_hinge_loss_model_reaches_its_margins():
    rows = [np.array([0, 5]), np.array([0, 6]), np.array([1, 5]), np.array([1, 6])] * 5
    label = np.array([1, 1, 0, 0] * 5)
    ratio = quality.log_count_ratio(rows, label)
    assert ratio[0] > 0 > ratio[1] and abs(ratio[5]) < 1e-6
    weight, bias = quality.dual_coordinate_descent(rows, label, ratio, cost=100.0, rounds=200)
    margins = [weight[r] @ ratio[r] / np.sqrt((ratio[r] ** 2).sum()) + bias for r in rows]
    assert all((m > 0.95) if y else (m < -0.95) for m, y in zip(margins, label))


@pytest.fixture(scope="module")
def channel(spark):
    text = " ".join(["the idiot and the moron saw a stupid clown in the trash", "it is a fine day for all of us", prose(200, 5)] * 3)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    return toxicity.Channel(toxicity.language_model(toxicity.trigram_counts(docs)))


@pytest.mark.parametrize("hidden,meant", [("1d1ot", "idiot"), ("m0ron", "moron"), ("Stuuuupid", "stupid"), ("cl0wn!", "clown"), ("tr@sh", "trash"), ("fine,", "fine"), ("2024", "2024"), ("", "")])
def test_words_are_restored(channel, hidden, meant):
    assert meant in channel.restore_word(hidden).split() or channel.restore_word(hidden) == meant.strip("0123456789")


def test_spaced_words_are_restored(channel):
    assert channel.restore_spaced("you m o r o n there") == ["moron"]
    assert channel.restore_spaced("an i.d.i.o.t here") == ["idiot"]
    assert channel.restore_spaced("a plain text") == []


@pytest.mark.parametrize("hidden,meant", [
    ("mooron", "moron"), ("sstupid", "stupid"), ("clownn", "clown"), ("$tupid", "stupid"), ("!diot", "idiot"),
    ("the_fine_day_and_the_moron_saw_" * 5 + "clown", "moron"), ("the.fine.day.and.the.tr@sh." * 4 + "day", "trash"),
    ("mo" + "o" * 90 + "ron", "moron"),
])
def test_doubled_outer_and_long_words_are_restored(channel, hidden, meant):
    assert meant in channel.restore_word(hidden).split()


@pytest.mark.parametrize("text", ["t r @ s h", "t  r  a  s  h", "so t\tr\na s h.", "t * r * a * s * h", "t r 4 $ h", "t-r-@-s-h!"])
def test_spaced_signs_of_every_kind_are_restored(channel, text):
    assert any("trash" in s.split() for s in channel.restore_spaced(text))


def test_long_runs_of_single_signs_take_linear_time(channel):
    assert channel.restore_spaced("a.* " * 20_000 + "b-cd")
    assert len(channel.restore_word("1@*" * 5_000)) > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("1406$@!*|ab.-_ "), min_size=1, max_size=200).map("".join))
def test_writing_down_what_is_shared_changes_nothing(channel, signs):
    whole = toxicity.UNDECIDED
    try:
        found = []
        for toxicity.UNDECIDED in (10 ** 9, 3, 40):
            found.append((channel.decode(signs), channel.decode(signs, True)))
    finally:
        toxicity.UNDECIDED = whole
    assert found[0] == found[1] == found[2]


def test_remembered_words_change_no_score(spark):
    texts = [f"{prose(20, k)} m0r0n {prose(10, k + 500)}" for k in range(20)] * 2
    rows = spark.createDataFrame([(k, t if k % 2 else prose(30, k)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    model = toxicity.fit(rows, labels)
    channel = toxicity.Channel(model.trigrams)
    once = model.scores(texts, channel)
    assert (model.scores(texts, channel) == once).all() and toxicity._MEMORY[0][2]
    toxicity._MEMORY.clear()
    assert (model.scores(texts[::-1], channel)[::-1] == once).all()


def test_hidden_toxic_words_count(spark):
    plain = [(k, f"{prose(20, k)} moron {prose(10, k + 500)}") for k in range(30)] + [(k, prose(30, k)) for k in range(30, 90)]
    docs = spark.createDataFrame([*plain, (100, f"{prose(10, 7)} m0r0n x"), (101, prose(10, 7) + " m o r o n x"), (102, prose(12, 7))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(90)], "doc_id bigint, toxic int")
    score = toxicity.scorer(toxicity.fit(docs, labels))
    found = dict(docs.where("doc_id >= 100").select("doc_id", score(F.col("text"))).collect())
    assert found[100] > 0.7 and found[101] > 0.7 and found[102] < 0.3
