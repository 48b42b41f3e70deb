"""Toxicity of text that hides its words: a noisy channel read backwards, then a score of what was meant.

A writer's letters pass a channel that swaps them for look-alikes, repeats them
or spaces them out.  What is read spans a lattice: each sign may stand for
itself, for the letters it looks like, for nothing (a repetition) or, between
single signs, for a gap that was put in.  The Viterbi path under a character
trigram model of all documents gives the restored words.  Words and their first
letters are weighed by how much more often they occur in toxic than in other
labelled documents, and a logistic curve turns the weights found into a score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import sample_by_hash, slices, words_of
from wayfind.llm.quality import logistic_curve

TRAIN_PER_CLASS = 6_000
THRESHOLD = 0.7
SYMBOLS = 64
GAP, OTHER = 0, 63
PREFIXES = (4, 5, 6)

# What signs are read as (own table of common look-alikes), and the channel's log probabilities.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou",
}
SAME, SWAPPED, REPEATED, SPACED, MEANT, LITERAL = -0.02, -2.5, -2.0, -2.0, -4.0, -6.0

OUTER = " \t\r\n.,;:?!\"'()[]{}<>%&*$#|~^=/\\-_`"
EDGE = "".join(c for c in OUTER if c not in LOOKALIKES)
DOUBLED, TRIPLED = re.compile(r"(.)\1", re.S), re.compile(r"(.)\1\1", re.S)
# Single letters, digits and look-alikes with white space or one separator between them; a star by itself is a sign, beside one a separator.
_STAR = r"(?<![^\s.\-_])\*(?![^\s.\-_])"
_SIGNS = r"[^\W_]|[" + re.escape("".join(c for c in LOOKALIKES if not c.isalnum() and c != "*")) + "]"
_SIGN = rf"(?:{_SIGNS}|{_STAR})"
_BETWEEN = rf"(?:\s*(?:[.\-_]|(?!{_STAR})\*)\s*|\s+)"
SINGLES = re.compile(rf"(?<!\S){_SIGN}(?:{_BETWEEN}{_SIGN}(?!(?![!¡]){_SIGN})){{2,}}(?:[.,!?;:]*)(?!\S)")
GAPS = re.compile(r"[\s.\-_*]+")
UNDECIDED = 256  # signs after which the part that all paths left share is written down
REMEMBERED = 300_000  # words of at most LONG_WORD signs whose known features a worker keeps
LONG_WORD = 64


def symbol(char: str) -> int:
    """The model's number of a character: a-z, 36 classes of other letters, a gap for the rest."""
    if "a" <= char <= "z":
        return 1 + ord(char) - 97
    return 27 + ord(char) % 36 if char.isalpha() else GAP


#: Symbols of the first 64k code points; what lies above counts by the same rule at its first use.
_TABLE: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([symbol(chr(c)) if not 0xD800 <= c < 0xE000 else GAP for c in range(1 << 16)], dtype=np.int32))
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    if len(code) and code.max() >= 1 << 16:
        return np.array([symbol(chr(c)) for c in code], dtype=np.int32)
    return _TABLE[0][code]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts: each task sums its own, then one row per trigram."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(map(len, texts), 4_000_000, 100_000):
                s = symbols_of("\n\n" + "\n\n".join(texts[a:b]) + "\n")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    out = np.zeros(SYMBOLS ** 3)
    found = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInPandas(count, "gram int, n bigint")
    for gram, n in found.groupBy("gram").agg(F.sum("n")).collect():  # at most SYMBOLS ** 3 rows
        out[gram] = n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third symbol after two, backed off to shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


class Channel:
    """Decodes hidden words under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.name = hashlib.sha256(np.ascontiguousarray(model).tobytes()).digest()

    def lattice(self, signs: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
        """For each sign what it may stand for: a letter, "" (nothing) or " " (a gap), with its cost.

        Between ``spaced`` single signs a gap is more likely put in than meant.
        """
        for k, sign in enumerate(signs):
            arcs = []
            if sign.isalpha():
                arcs.append((sign, SAME))
            else:
                gap = bool(GAPS.fullmatch(sign))
                arcs.append((" ", (MEANT if spaced else SAME) if gap else LITERAL))
                arcs += [(c, SWAPPED) for c in LOOKALIKES.get(sign, "")]
                if gap:
                    arcs.append(("", SAME if spaced else SPACED))
            if k and sign == signs[k - 1]:
                arcs.append(("", REPEATED / 4 if k > 1 and sign == signs[k - 2] else REPEATED))
            yield arcs

    def decode(self, signs: str, spaced: bool = False) -> str:
        """The most likely text behind ``signs`` (lower case), by Viterbi over the last two symbols.

        What all paths left have in common is written down now and then, so
        that a long word holds little more than its undecided end.
        """
        model, out = self.model, []
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(GAP, GAP): (0.0, None)}
        looked, wait = 0, UNDECIDED
        for k, arcs in enumerate(self.lattice(signs, spaced)):
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for letter, price in arcs:
                    if letter:
                        c = symbol(letter)
                        state, total, way = (b, c), cost + price + model[a][b][c], (letter, path)
                    else:
                        state, total, way = (a, b), cost + price, path
                    if state not in reached or total > reached[state][0]:
                        reached[state] = (total, way)
            best = reached
            if len(best) == 1:  # all paths run through this state: what is before it is decided
                [(state, (total, path))] = best.items()
                out += _letters(path)
                best, looked, wait = {state: (total, None)}, k, UNDECIDED
            elif k - looked >= wait:
                told = {state: _letters(path) for state, (_, path) in best.items()}
                same = _shared(list(told.values()))
                out += next(iter(told.values()))[:same]
                best = {state: (total, _chain(told[state][same:])) for state, (total, _) in best.items()}
                looked, wait = k, UNDECIDED if same else 2 * wait
        (a, b), (_, path) = max(best.items(), key=lambda x: (x[1][0] + model[x[0][0]][x[0][1]][GAP], x[0]))
        return "".join(out + _letters(path))

    def restore_word(self, word: str) -> str:
        """One white-space word of any length: plain ones as they are, lower case and without outer signs.

        Doubled letters, numbers and outer look-alikes may also be meant as
        written, so that both readings are given.
        """
        low = word.lower()
        core, whole = low.strip(OUTER), low.strip(EDGE)
        found = [core]
        if core and (not core.isalpha() or DOUBLED.search(core)):
            literal = core.isalpha() and not TRIPLED.search(core) or not any(map(str.isalpha, core))
            found = [core, self.decode(core)] if literal else [self.decode(core)]
        if whole != core:
            found.append(self.decode(whole))
        return " ".join(dict.fromkeys(found))

    def restore_spaced(self, text: str) -> list[str]:
        """What runs of single signs may spell together, also with their outer look-alikes as letters."""
        runs = [run.group().lower() for run in SINGLES.finditer(text)]
        return [self.decode(r, True) for run in runs for r in dict.fromkeys([run.strip(OUTER), run.strip(EDGE)])]


def _letters(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        letter, path = path
        out.append(letter)
    return out[::-1]


def _chain(letters: list[str]) -> tuple | None:
    path = None
    for letter in letters:
        path = (letter, path)
    return path


def _shared(lists: list[list[str]]) -> int:
    """How many items all lists begin with."""
    first, last = min(lists), max(lists)  # what these two share, all between them share
    return next((k for k, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))


def features(restored: str) -> list[int]:
    """Hashed features of restored words: each word, and its first letters."""
    out = []
    for word in restored.split():
        out.append(xxhash.xxh3_64_intdigest("=" + word))
        out += [xxhash.xxh3_64_intdigest(word[:n]) for n in PREFIXES if len(word) >= n]
    return out


def hidden(texts: list[str], channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all restored words of some texts, each pair once."""
    row, code, distinct = words_of(texts)
    sets = [features(channel.restore_word(w)) for w in distinct]
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.array([f for s in sets for f in s], dtype=np.uint64)
    starts = np.cumsum(lengths) - lengths
    pair = np.unique(row * max(1, len(distinct)) + code)
    row, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    n = lengths[code]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows, feats = np.repeat(row, n), flat[np.repeat(starts[code], n) + inner]
    more = [(k, f) for k, t in enumerate(texts) for s in channel.restore_spaced(t) for f in features(s)]
    if more:
        rows = np.concatenate([rows, np.array([m[0] for m in more])])
        feats = np.concatenate([feats, np.array([m[1] for m in more], dtype=np.uint64)])
    order = np.lexsort((feats, rows))
    rows, feats = rows[order], feats[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (feats[1:] != feats[:-1])
    return rows[first], feats[first]


#: Of the model that this worker scored with last: its known features, and what they are in words met before.
_MEMORY: list[tuple[bytes, set[int], dict[str, tuple[int, ...]]]] = []


def _memory(keys: np.ndarray, channel: Channel) -> tuple[set[int], dict[str, tuple[int, ...]]]:
    name = channel.name + hashlib.sha256(keys.tobytes()).digest()
    if not _MEMORY or _MEMORY[0][0] != name:
        _MEMORY[:] = [(name, set(keys.tolist()), {})]
    return _MEMORY[0][1:]


@dataclass
class ToxicityModel:
    trigrams: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def evidence(self, texts: list[str], channel: Channel) -> np.ndarray:
        """Each text's toxic features on a log scale; cubed weights keep many weak ones below one strong one."""
        total = np.zeros(len(texts))
        if len(self.keys):
            rows, feats = self._found(texts, channel)
            at = np.minimum(np.searchsorted(self.keys, feats), len(self.keys) - 1)
            hit = self.keys[at] == feats
            total = np.bincount(rows[hit], self.weights[at[hit]] ** 3, len(texts))
        return np.log1p(total / 50)

    def _found(self, texts: list[str], channel: Channel) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (row, known feature); words without one are dropped before they are spread over rows."""
        row, code, distinct = words_of(texts)
        known, memory = _memory(self.keys, channel)
        sets = []
        for word in distinct:
            found = memory.get(word)
            if found is None:
                found = tuple([f for f in features(channel.restore_word(word)) if f in known])
                if len(word) <= LONG_WORD and len(memory) < REMEMBERED:
                    memory[word] = found
            sets.append(found)
        rich = np.array([bool(s) for s in sets], dtype=bool)
        keep = rich[code] if len(code) else np.zeros(0, dtype=bool)
        rows, feats = [], []
        for r, c in set(zip(row[keep].tolist(), code[keep].tolist())):
            rows += [r] * len(sets[c])
            feats += sets[c]
        for k, text in enumerate(texts):
            for s in channel.restore_spaced(text):
                found = [f for f in features(s) if f in known]
                rows += [k] * len(found)
                feats += found
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        pair = sorted(set(zip(rows, feats)))
        return np.array([p[0] for p in pair]), np.array([p[1] for p in pair], dtype=np.uint64)

    def scores(self, texts: list[str], channel: Channel) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts, channel) + self.shift, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "toxic",
        id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_PER_CLASS) -> ToxicityModel:
    """The character model of all documents; word weights of at most ``per_class`` labelled ones of each class.

    ``learn`` is a condition on the id column of ``labels`` (default: all).
    Null labels and ids are left out; an id labelled twice takes the higher
    label.  Without both classes the score is the share of label 1.
    """
    model = language_model(trigram_counts(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if learn is None else known.where(learn)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    counts = {bool(r[0]): r[1] for r in known.groupBy(F.col("_y") > 0).count().collect()}
    chosen = sample_by_hash(known.where("_y > 0"), per_class, "_id").unionByName(sample_by_hash(known.where("_y <= 0"), per_class, "_id"))
    total = {True: min(per_class, counts.get(True, 0)), False: min(per_class, counts.get(False, 0))}
    share = counts.get(True, 0) / max(1, sum(counts.values())) if counts else 0.5
    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if not total[True] or not total[False]:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return ToxicityModel(model, *nothing, 0.0, float(np.log(p / (1 - p))))
    texts = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id").select("_id", "_text", (F.col("_y") > 0).cast("int").alias("_y"))
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(model)
        for batch in batches:
            batch_texts, y = batch["_text"].tolist(), batch["_y"].to_numpy()
            for a, b in slices(map(len, batch_texts), 8_000_000, 4_000):
                rows, feats = hidden(batch_texts[a:b], channel)
                at, inverse = np.unique(feats, return_inverse=True)
                bad = np.bincount(inverse, y[a:b][rows], len(at)).astype(np.int64)
                yield pd.DataFrame({"f": at.view(np.int64), "bad": bad, "fine": np.bincount(inverse, minlength=len(at)) - bad})

    bad = (F.col("bad") + 0.1) / (total[True] + 0.2)
    fine = (F.col("fine") + 0.1) / (total[False] + 0.2)
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("fine") + 0.5))  # one standard error: a few chance finds weigh little
    weighed = (
        texts.mapInPandas(count, "f bigint, bad bigint, fine bigint")
        .groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
        .where("bad >= 4").withColumn("w", F.log(bad / fine) - doubt).where("w > 2.5").select("f", "w")
    )
    found = sorted((r.f & (1 << 64) - 1, r.w) for r in weighed.collect())  # bounded by the sample's own words
    toxic = ToxicityModel(model, np.array([f for f, _ in found], dtype=np.uint64), np.array([w for _, w in found]), 0.0, 0.0)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(model)
        for batch in batches:
            yield pd.DataFrame({"x": toxic.evidence(batch["_text"].tolist(), channel), "y": batch["_y"]})

    rows = texts.mapInPandas(evidence, "x double, y int").collect()
    toxic.slope, toxic.shift = logistic_curve(np.array([r.x for r in rows]), np.array([r.y for r in rows]), share)
    return toxic


def scorer(model: ToxicityModel):
    """A function of the text column: the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel = Channel(model.trigrams)
        for batch in batches:
            texts = batch.tolist()
            parts = [model.scores(texts[a:b], channel) for a, b in slices(map(len, texts), 8_000_000, 5_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return lambda text: score(F.coalesce(text, F.lit("")))
