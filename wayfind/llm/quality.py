"""Document quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``WIDTH`` columns: byte trigrams of
the text, and one to three word shapes in a row (case, digits, length, closing
signs, and whether a word repeats the one before).  Each indicator is scaled by
its class log-count ratio; a linear hinge-loss model of the scaled, unit-length
rows is fitted by dual coordinate descent, and its margin becomes a probability
by a logistic curve at the class shares of all labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import give_back, mixed, sample_by_hash, slices, words_of

WIDTH = 1 << 15
TRAIN_PER_CLASS = 2_000
THRESHOLD = 0.7


def shape(word: str) -> int:
    """A number for the outer form of a word."""
    core = word.rstrip("".join({c for c in word[-3:] if not c.isalnum()}))
    case = "U" if len(core) > 1 and core.isupper() else "T" if core[:1].isupper() else "l" if core[:1].islower() else "o"
    digits = "d" if any(c.isdigit() for c in core) else ""
    size = min(len(core), 30).bit_length()
    return zlib.crc32(f"{case}{digits}{size}{word[len(core):][:3]}".encode())


def indicators(texts: list[str]) -> np.ndarray:
    """A (texts x WIDTH) table of flags: which hashed n-grams occur in which text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    flat = out.reshape(-1)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(raw), dtype=np.int64) * WIDTH, [len(r) for r in raw])
    if len(data) > 2:
        gram = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        at = (gram * np.uint32(0x9E3779B1)) >> np.uint32(17)
        whole = row[:-2] == row[2:]
        flat[(row[:-2] + at)[whole]] = 1
    row, code, distinct = words_of(texts)
    if len(code):
        form = np.array([shape(w) for w in distinct], dtype=np.uint64)[code]
        again = np.zeros(len(code), dtype=np.uint64)
        again[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        form = mixed(form * np.uint64(2) + again + np.uint64(1))
        gram = form
        for n in (1, 2, 3):
            if n > 1:
                if len(form) < n:
                    break
                gram = mixed(gram[:-1] * np.uint64(31) + form[n - 1:])
            whole = row[:len(gram)] == row[n - 1:]
            at = (gram >> np.uint64(49)).astype(np.int64)
            flat[(row[:len(gram)] * WIDTH + at)[whole]] = 1
    return out


@dataclass
class QualityModel:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, flags: np.ndarray) -> np.ndarray:
        found = flags.astype(np.float32)
        norm = np.sqrt(found @ (self.ratio * self.ratio)) + 1e-6
        return (found @ (self.ratio * self.weight)) / norm + self.bias

    def scores(self, flags: np.ndarray) -> np.ndarray:
        z = self.slope * self.margins(flags).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.zeros((2, WIDTH)) + smooth
    for at, y in zip(rows, label):
        counts[int(y), at] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0]).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float = 10.0,
                            rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Squared-hinge linear model of scaled unit rows, one dual variable at a time."""
    sign = np.where(label > 0, 1.0, -1.0)
    weight, bias = np.zeros(WIDTH), 0.0
    alpha = np.zeros(len(rows))
    values = [ratio[at] / (np.sqrt((ratio[at] ** 2).sum()) + 1e-6) for at in rows]
    order = np.random.default_rng(seed)
    diagonal = 1 / (2 * cost)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i], values[i]
            slope = sign[i] * (weight[at] @ x + bias) - 1 + diagonal * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            largest = max(largest, abs(slope))
            new = max(0.0, alpha[i] - slope / (2.0 + diagonal))  # a unit row and the bias
            weight[at] += (new - alpha[i]) * sign[i] * x
            bias += (new - alpha[i]) * sign[i]
            alpha[i] = new
        if largest < 1e-3:
            break
    return weight.astype(np.float32), bias


def logistic_curve(margin: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, classes weighted to ``share`` of label 1."""
    if not len(label):
        return 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    ones = max(1, int((label > 0).sum()))
    zeros = max(1, int((label <= 0).sum()))
    weight = np.where(label > 0, share / ones, (1 - share) / zeros) * len(label)
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))

    def loss(at: np.ndarray) -> float:
        z = at[0] * margin + at[1]
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * ridge * at[0] ** 2)

    ridge = 1e-3 * len(label)
    at = np.array([0.0, np.log(share / (1 - share)) if 0 < share < 1 else 0.0])
    for _ in range(100):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + ridge * at[0], g.sum()])
        hess = np.array([[(h * margin * margin).sum() + ridge, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if size <= 1e-6 or np.abs(step).max() < 1e-6:
            break
    a, b = at
    return max(float(a), 0.0), float(b)


def fit_rows(packed: list[bytes], label: np.ndarray, share: float) -> QualityModel:
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))) for p in packed]
    if not len(label) or label.min() == label.max():  # one class or none: a constant score
        p = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    # The curve is fitted on margins of rows that the model of the other part has not seen.
    part = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(part != k)
        if label[inside].min() == label[inside].max():
            continue
        ratio = log_count_ratio([rows[i] for i in inside], label[inside])
        weight, bias = dual_coordinate_descent([rows[i] for i in inside], label[inside], ratio)
        for i in np.flatnonzero(part == k):
            r = ratio[rows[i]]
            margin[i] = (weight[rows[i]] @ r) / (np.sqrt(r @ r) + 1e-6) + bias
    slope, shift = logistic_curve(margin, label, share)
    ratio = log_count_ratio(rows, label)
    weight, bias = dual_coordinate_descent(rows, label, ratio)
    return QualityModel(ratio, weight, bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality",
        id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_PER_CLASS) -> QualityModel:
    """A model of at most ``per_class`` labelled documents of each class, the first by a hash of the id.

    ``learn`` is a condition on the id column of ``labels`` (default: all).
    Null labels and ids are left out; an id labelled twice takes the lower
    label.  Without both classes the score is the share of label 1.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if learn is None else known.where(learn)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    counts = {bool(r[0]): r[1] for r in known.groupBy(F.col("_y") > 0).count().collect()}
    chosen = sample_by_hash(known.where("_y > 0"), per_class, "_id").unionByName(sample_by_hash(known.where("_y <= 0"), per_class, "_id"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            for a, b in slices(map(len, texts), 500_000, 64):
                yield pd.DataFrame({"id": batch["_id"][a:b], "y": batch["_y"][a:b], "bits": [np.packbits(f).tobytes() for f in indicators(texts[a:b])]})

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").mapInPandas(features, "id bigint, y int, bits binary")
    rows = rows.dropDuplicates(["id"]).orderBy("id").collect()  # at most two classes of per_class rows
    share = counts.get(True, 0) / max(1, sum(counts.values())) if counts else 0.5
    return fit_rows([r.bits for r in rows], np.array([r.y > 0 for r in rows], dtype=int), share)


def scorer(model: QualityModel):
    """A function of the text column: the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            parts = [model.scores(indicators(texts[a:b])) for a, b in slices(map(len, texts), 500_000, 64)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        give_back()

    return lambda text: score(F.coalesce(text, F.lit("")))
