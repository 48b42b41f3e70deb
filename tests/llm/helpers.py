"""Small tables with all the awkward rows."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "sha", "on") for b in ("n", "ra", "ti", "s", "lem", "d", "vo")]

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "id bigint, body string, row string, label bigint, key bigint, score double, kept boolean, _id bigint, _text string, print bigint"
)


def prose(words: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(words))


def awkward(spark, rows=None):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    if rows is None:
        long = prose(30_000, 1)
        base = prose(120, 2)
        rows = [
            (1, base, "en"), (2, base, "en"), (3, base + " kan lora", "de"), (4, None, "en"), (5, "", None),
            (6, "", "fr"), (7, long, "en"), (8, prose(60, 3), None), (8, prose(60, 3), None), (None, prose(50, 4), "es"),
            (None, None, None), (9, "a", "en"), (10, "日本語 " * 30 + "\U0001f600", "ja"), (11, "1234 5678 !!", "en"),
            (12, base.upper(), "en"), (13, long, "en"),
        ]
    return spark.createDataFrame(
        [(i, t, lang, "src", len(t) if t is not None else None, 7, "x", "y", 1, 2, 0.5, True, 3, "z", 4) for i, t, lang in rows], SCHEMA
    )


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
