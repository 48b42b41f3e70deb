"""Languages of words and texts by a linear-chain conditional random field.

Every word with a letter is a position of a chain (a sentence); its label is a
language.  A label's score at a word is the sum of learned weights of the word's
affixes, inner n-grams and lexicon entries; learned transitions join
neighbours.  Forward-backward gives each word's label probabilities, also where
a text switches languages; a text's language is the one with the largest sum.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import slices, words_of

BITS = 18
WIDTH = 1 << BITS
PER_LANGUAGE = 400
SPANS = 12
SPAN_WORDS = 12
UNKNOWN = "und"
OUTER = " .,;:?!\"'()[]{}<>%&*$#|~^=/\\-_`0123456789"


CACHED_WORDS = 700_000
#: Scores of known words by model, one model at a time.
_KNOWN: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def core(word: str) -> str:
    """The word without outer signs, in lower case; empty without a letter."""
    inner = word.strip(OUTER).lower()
    return inner if any(map(str.isalpha, inner)) else ""


def word_features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Hashed features of one ``core`` word: affixes, three-letter runs, the word, its lexicon entry."""
    marked = f"<{word}>"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3, 4)]
    names += [marked[k:k + 3] for k in range(len(marked) - 2)]
    names.append(f"w{word}")
    entry = lexicon.get(word)
    if entry:
        names.append(f"l{entry}")
    mask, crc = WIDTH - 1, zlib.crc32
    return [crc(n.encode()) & mask for n in names]


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transition: np.ndarray,
                     first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every position of many chains at once, and the scaled forward and backward parts.

    ``scores`` holds the positions of all chains; chain ``i`` is ``lengths[i]``
    of them from ``starts[i]``.  Step t works on all chains that are longer.
    """
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transition)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    forward, backward = np.empty_like(weight), np.ones_like(weight)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    at = starts
    state = weight[at] * np.exp(first)
    state /= state.sum(axis=1, keepdims=True)
    forward[at] = state
    for t in range(1, longest):
        at = starts[:active[t]] + t
        state = (state[:active[t]] @ step) * weight[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    state = np.ones((0, weight.shape[1]))
    for t in range(longest - 1, 0, -1):
        n = active[t]
        if len(state) < n:  # chains that end here
            state = np.concatenate([state, np.ones((n - len(state), weight.shape[1]))])
        state = (state * weight[starts[:n] + t]) @ step.T
        state /= state.sum(axis=1, keepdims=True)
        backward[starts[:n] + t - 1] = state
    joint = forward * backward
    return joint / joint.sum(axis=1, keepdims=True), forward, weight * backward


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    first: np.ndarray
    lexicon: dict[str, str]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def cached_scores(self, words: list[str]) -> np.ndarray:
        """``word_scores``, with those of earlier texts of this Python worker looked up."""
        if self.name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[self.name] = ({}, [np.zeros((0, len(self.languages)))])
        known, tables = _KNOWN[self.name]
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(fresh) > CACHED_WORDS:
            known.clear()
            tables[0] = tables[0][:0]
            fresh = list(dict.fromkeys(words))
        if fresh:
            start = len(known)
            known.update((w, start + k) for k, w in enumerate(fresh))
            table = tables[0]
            if len(table) < len(known):  # room for twice as many
                table = np.zeros((2 * len(known), len(self.languages)))
                table[:start] = tables[0][:start]
                tables[0] = table
            table[start:len(known)] = self.word_scores(fresh)
        return tables[0][np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Label scores of ``core`` words; an empty one scores nothing."""
        sets = [word_features(w, self.lexicon) if w else [] for w in words]
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.fromiter((f for s in sets for f in s), dtype=np.int64, count=int(counts.sum()))
        out = np.zeros((len(words), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full):
            begins = (np.cumsum(counts) - counts)[full]
            out[full] = np.add.reduceat(self.weights[flat], begins, axis=0)
        return out

    def label_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, label probabilities) of each word with a letter, in order."""
        row, code, distinct = words_of(texts)
        cores = [core(w) for w in distinct]
        worded = np.array([bool(c) for c in cores], dtype=bool)
        closing = np.array([w[-1:] in ".!?" for w in distinct], dtype=bool)
        scores = self.cached_scores(cores)
        if not len(code):
            return row, np.zeros((0, len(self.languages)))
        chain = np.zeros(len(code), dtype=np.int64)
        chain[1:] = np.cumsum(closing[code[:-1]] | (row[1:] != row[:-1]))
        keep = worded[code]
        row, code, chain = row[keep], code[keep], chain[keep]
        if not len(code):
            return row, np.zeros((0, len(self.languages)))
        starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(code)]]))
        return row, forward_backward(scores[code], starts, lengths, self.transition, self.first)[0]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the label probabilities; ``und`` and 0 without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        row, probability = self.label_words(texts)
        total = np.stack([np.bincount(row, probability[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        words = np.bincount(row, minlength=len(texts))
        best = total.argmax(axis=1)
        share = total[np.arange(len(texts)), best] / np.maximum(words, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, words)], np.where(words > 0, np.clip(share, 0, 1), 0.0)


def make_lexicon(spans: list[tuple[str, list[str]]], least: int = 4) -> dict[str, str]:
    """Words of the sample seen ``least`` times or more: the language they mostly occur in, and how surely."""
    counts: dict[str, Counter] = {}
    for language, words in spans:
        for word in words:
            counts.setdefault(word, Counter())[language] += 1
    out = {}
    for word, by in counts.items():
        total = sum(by.values())
        if total >= least:
            language, n = min(by.items(), key=lambda x: (-x[1], x[0]))
            out[word] = f"{language}{int(4 * n / total)}"
    return out


def train(spans: list[tuple[str, list[str]]], rounds: int = 4, batch: int = 128, rate: float = 0.2, seed: int = 5) -> LanguageModel:
    """Weights that raise the likelihood of labelled spans, by adaptive gradient steps.

    Chains are spans of one to three documents put one after the other, so the
    transitions are learned from switches as well.
    """
    languages = sorted({language for language, _ in spans})
    spans = [(language, [w for w in map(core, words) if w]) for language, words in spans]
    spans = [s for s in spans if s[1]]
    size = len(languages)
    model = LanguageModel(languages, np.zeros((WIDTH, size)), np.zeros((size, size)), np.zeros(size), make_lexicon(spans))
    if size < 2:
        return model
    number = {language: k for k, language in enumerate(languages)}
    words = sorted({w for _, ws in spans for w in ws})
    index = {w: k for k, w in enumerate(words)}
    sets = [np.array(word_features(w, model.lexicon)) for w in words]
    random = np.random.default_rng(seed)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.transition, model.first)]
    for _ in range(rounds):
        order = random.permutation(len(spans))
        joins = random.integers(1, 4, size=len(spans))
        chains, k = [], 0
        for n in joins:
            if k >= len(order):
                break
            chains.append(order[k:k + n])
            k += n
        for b in range(0, len(chains), batch):
            part = chains[b:b + batch]
            code = np.array([index[w] for c in part for s in c for w in spans[s][1]])
            label = np.array([number[spans[s][0]] for c in part for s in c for _ in spans[s][1]])
            lengths = np.array([sum(len(spans[s][1]) for s in c) for c in part])
            starts = np.cumsum(lengths) - lengths
            used, where = np.unique(code, return_inverse=True)
            counts = np.array([len(sets[u]) for u in used])
            flat = np.concatenate([sets[u] for u in used])
            scores = np.add.reduceat(model.weights[flat], np.cumsum(counts) - counts, axis=0)[where]
            found, forward, ahead = forward_backward(scores, starts, lengths, model.transition, model.first)
            error = found.copy()
            error[np.arange(len(label)), label] -= 1
            per_word = np.zeros((len(used), size))
            np.add.at(per_word, where, error)
            at, inverse = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(at), size))
            np.add.at(slope, inverse, np.repeat(per_word, counts, axis=0))
            slope = slope / len(part) + 1e-5 * model.weights[at]
            squares[0][at] += slope ** 2
            model.weights[at] -= rate * slope / np.sqrt(squares[0][at])
            inner = np.ones(len(label), dtype=bool)
            inner[starts] = False
            here = np.flatnonzero(inner)
            pair = forward[here - 1][:, :, None] * np.exp(model.transition)[None] * ahead[here][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            slope = pair.sum(axis=0)
            np.subtract.at(slope, (label[here - 1], label[here]), 1)
            slope = slope / len(part) + 1e-3 * model.transition
            squares[1] += slope ** 2
            model.transition -= rate * slope / np.sqrt(squares[1])
            slope = found[starts].sum(axis=0)
            np.subtract.at(slope, label[starts], 1)
            slope = slope / len(part) + 1e-3 * model.first
            squares[2] += slope ** 2
            model.first -= rate * slope / np.sqrt(squares[2])
    return model


def fit(docs: DataFrame, learn: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id",
        text_col: str = "text", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of about ``per_language`` documents of each language, the first by a hash of the id.

    ``learn`` is a condition on the id column (default: all).  Rows with a null
    id, text or language teach nothing.  ``SPANS`` spans of ``SPAN_WORDS`` words
    are taken from each sample document, evenly spread.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if learn is None else known.where(learn)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return LanguageModel([], np.zeros((WIDTH, 0)), np.zeros((0, 0)), np.zeros(0), {})
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)])
    chosen = known.where(place < F.element_at(share, F.col(lang_col)))
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def spans_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, lang, text in zip(batch["id"], batch["lang"], batch["text"]):
                words = text.split()
                pieces = [words[k:k + SPAN_WORDS] for k in range(0, len(words), SPAN_WORDS)]
                step = max(1, -(-len(pieces) // SPANS))
                out += [(doc, k, lang, " ".join(p)) for k, p in enumerate(pieces[::step])]
            yield pd.DataFrame(out, columns=["id", "k", "lang", "span"])

    spans = chosen.mapInPandas(spans_of, "id bigint, k int, lang string, span string").orderBy("id", "k", "lang", "span")
    bound = 2 * per_language * SPANS * len(counts)
    return train([(r.lang, r.span.split()) for r in spans.limit(bound).collect()])


def predictor(model: LanguageModel):
    """A function of the text column: a struct of ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            parts = [model.predict(texts[a:b]) for a, b in slices(map(len, texts), 6_000_000, 5_000)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else []})

    return lambda text: predict(F.coalesce(text, F.lit("")))
