"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Every kind has a pattern, a validator (Luhn, mod-97, digit counts, number
ranges) and the words that usually stand beside such a value.  A proposal that
its validator refuses is gone, without another try inside it.  The kinds of
``BASE`` are kept whenever they are confirmed; the other kinds are weaker
patterns, kept if their score, raised by a word nearby, reaches the threshold
and no base span overlaps them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import give_back

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "national_id", "local_phone")
KINDS = BASE + ADDED
THRESHOLD = 0.5
NEAR = 40
SPANS = "array<struct<kind string, start bigint, end bigint, score double>>"

# Numbers are looked for where a run of digits starts, once per text; patterns never give characters back,
# so that a long run is read once.
RUN = re.compile(r"[0-9]+")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
LOCAL_PHONE = re.compile(r"(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,2}(?![0-9])")
WORD = re.compile(r"[^\W\d_]+")

# Words that stand beside a value, by kind: fixed values in English, German, French and Spanish.
WORDS = {
    "email": ("email", "mail", "contact", "address", "kontakt", "adresse", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "express", "diners", "credit", "debit", "payment", "karte", "kreditkarte", "carte", "tarjeta"),
    "national_id": ("ssn", "social", "security", "insurance", "identity", "id"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil"),
}
# Score of a confirmed span without and with such a word: fixed values.
SCORES = {
    "email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95),
    "iban": (0.8, 1.0), "short_card": (0.3, 0.8), "national_id": (0.45, 0.9), "local_phone": (0.2, 0.7),
}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others; every second digit from the right counts double."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of bank account codes: country and check digits go last, letters count from 10, the rest must be 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


Found = Iterator[tuple[int, int]]


def emails(text: str, runs: list[int]) -> Found:
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in NAME_SIGNS:
            start -= 1
        found = EMAIL_HOST.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        used = found.end() if found else at + 1
        at = text.find("@", used)


def _matches(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches at the starts, those inside the one before left out."""
    used = 0
    for start in starts:
        if start >= used and (m := pattern.match(text, start)):
            used = m.end()
            yield m


def ips(text: str, runs: list[int]) -> Found:
    for m in _matches(IP, text, runs):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(least: int, most: int) -> Callable[[str, list[int]], Found]:
    def found(text: str, runs: list[int]) -> Found:
        for m in _matches(CARD, text, runs):
            if m.end() - m.start() >= least:
                digits = digits_of(m.group())
                if least <= len(digits) <= most and luhn(digits):
                    yield m.span()

    return found


def phones(text: str, runs: list[int]) -> Found:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                yield m.span()


def ibans(text: str, runs: list[int]) -> Found:
    """The longest end that the check confirms; a code ends where a word ends."""
    starts = [r - 2 for r in runs if r >= 2 and "A" <= text[r - 1] <= "Z" and "A" <= text[r - 2] <= "Z" and not (r > 2 and text[r - 3].isalnum())]
    for m in _matches(IBAN, text, starts):
        for end in range(m.end(), m.start() + 14, -1):
            if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " ":
                code = text[m.start():end].replace(" ", "")
                if len(code) >= 15 and mod97(code):
                    yield m.start(), end
                    break


def _apart(text: str, start: int, signs: str) -> bool:
    """Whether no letter, digit or one of ``signs`` stands right before ``start``."""
    return start == 0 or not (text[start - 1].isalnum() or text[start - 1] in signs)


def national_ids(text: str, runs: list[int]) -> Found:
    for m in _matches(NATIONAL_ID, text, [r for r in runs if _apart(text, r, "-")]):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str, runs: list[int]) -> Found:
    starts = [r - 1 if r and text[r - 1] == "(" else r for r in runs]
    for m in _matches(LOCAL_PHONE, text, [r for r in starts if _apart(text, r, "+.-")]):
        if 8 <= len(digits_of(m.group())) <= 12:
            yield m.span()


FINDERS: dict[str, Callable[[str, list[int]], Found]] = {
    "email": emails, "ip": ips, "card": _cards(16, 19), "phone": phones,
    "iban": ibans, "short_card": _cards(13, 15), "national_id": national_ids, "local_phone": local_phones,
}


def scored(kind: str, text: str, start: int, end: int) -> float:
    """The score of a confirmed span: higher if a word of its kind stands within ``NEAR`` characters."""
    beside = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    alone, with_word = SCORES[kind]
    return with_word if any(w in WORDS[kind] for w in WORD.findall(beside.lower())) else alone


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    runs = [m.start() for m in RUN.finditer(text)]
    out = [Span(kind, a, b, scored(kind, text, a, b)) for kind in BASE for a, b in FINDERS[kind](text, runs)]
    if not runs:
        return out
    taken = sorted((s.start, s.end) for s in out)
    for kind in ADDED:
        for a, b in FINDERS[kind](text, runs):
            score = scored(kind, text, a, b)
            if score >= threshold and not any(x < b and a < y for x, y in taken):
                out.append(Span(kind, a, b, score))
                taken.append((a, b))
    return out


def personal_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """Array of (kind, start, end, score) in code points, end exclusive; empty for a null or empty text."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: [(s.kind, s.start, s.end, s.score) for s in spans_of(t, threshold)])
        give_back()
        return out

    return found(text)


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def with_spans(docs: DataFrame, name: str = "spans", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, and the spans as a further column ``name``."""
    return docs.withColumn(name, personal_spans(F.col(f"`{text_col}`"), threshold))


def redacted(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns; each span of the text becomes ``[kind]``, overlapping ones the first by start.  Null stays null."""

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s in sorted(spans_of(text, threshold), key=lambda s: (s.start, -s.end)):
                if s.start >= at:
                    out += [text[at:s.start], f"[{s.kind}]"]
                at = max(at, s.end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.select(*[hidden(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
