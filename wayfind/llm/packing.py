"""Vector bin packing of tokenised documents into fixed-length sequences.

An example is a vector of three sizes: tokens, segments (1) and loss-bearing
tokens.  A sequence has a limit on each.  Examples of a block of documents are
placed in descending token order; each goes to the open sequence whose
remaining capacity has the largest dot product with the example's sizes (both
as shares of the limits), among those it fits.  Documents may be cut, so what
the heuristic leaves open is filled: the emptiest sequences are taken apart and
their examples cut to the gaps of the fuller ones, and the last remainder is cut
at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import give_back

LENGTH = 2048
SEGMENTS = 256
BLOCK_TOKENS = 8_000_000
CACHED_WORDS = 1_200_000
TASK_WORDS = 300_000
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
END_ID = 1


@dataclass
class Piece:
    """``length`` tokens of document ``doc`` (its number in the block) from ``start``; ``loss`` of them bear loss."""

    doc: int
    start: int
    length: int
    loss: int

    def cut(self, length: int, loss_of) -> tuple[Piece, Piece]:
        """The first ``length`` tokens, and the rest."""
        loss = loss_of(self.doc, self.start, length)
        return (
            Piece(self.doc, self.start, length, loss),
            Piece(self.doc, self.start + length, self.length - length, self.loss - loss),
        )


def place(pieces: list[Piece], length: int, segments: int, loss: int) -> list[list[Piece]]:
    """Dot-product placement of pieces of at most ``length`` tokens and ``loss`` loss tokens each."""
    limit = np.array([length, segments, loss], dtype=np.float64)
    left = np.zeros((max(64, len(pieces)), 3))  # free shares; rows below ``used`` are sequences
    used, bins = 0, []
    open_rows = np.zeros(0, dtype=np.int64)
    for piece in sorted(pieces, key=lambda p: (-p.length, p.doc, p.start)):
        need = np.array([piece.length, 1, piece.loss]) / limit
        room = left[open_rows]
        fits = (room >= need - 1e-12).all(axis=1)
        if fits.any():
            at = open_rows[np.argmax(np.where(fits, room @ need, -1.0))]
        else:
            at = used
            used += 1
            left[at] = 1.0
            bins.append([])
            open_rows = np.append(open_rows, at)
        left[at] -= need
        bins[at].append(piece)
        if (left[at] < 1 / limit - 1e-12)[:2].any():  # not one token or segment more
            open_rows = open_rows[open_rows != at]
    return bins


def fill(bins: list[list[Piece]], length: int, segments: int, loss: int, loss_of) -> list[list[Piece]]:
    """Cut the pieces of the emptiest sequences to the gaps of the fuller ones."""
    size = lambda b: sum(p.length for p in b)
    ordered = sorted(bins, key=size, reverse=True)
    done: list[list[Piece]] = []
    front, back, spare = 0, len(ordered), []
    while front < back:
        target = ordered[front]
        front += 1
        gap, bears = length - size(target), loss - sum(p.loss for p in target)
        while gap > 0 and len(target) < segments:
            if not spare:
                if front >= back:
                    break
                back -= 1
                spare = ordered[back]
            piece = spare.pop()
            take = min(gap, piece.length)
            if loss_of(piece.doc, piece.start, take) > bears:
                spare.append(piece)
                break
            if take < piece.length:
                piece, rest = piece.cut(take, loss_of)
                spare.append(rest)
            target.append(piece)
            gap -= take
            bears -= piece.loss
        done.append(target)
    rest = [*spare]
    while rest:  # one sequence or less of tokens
        here, held = [], 0
        want = min(length, 1 << (sum(p.length for p in rest).bit_length() - 1))
        while held < want and rest and len(here) < segments and sum(p.loss for p in here) <= loss:
            piece = rest.pop()
            if piece.length > want - held:
                piece, after = piece.cut(want - held, loss_of)
                rest.append(after)
            if sum(p.loss for p in here) + piece.loss > loss and here:
                rest.append(piece)
                break
            here.append(piece)
            held += piece.length
        done.append(here)
    return [b for b in done if b]


def at_powers(bins: list[list[Piece]], length: int, loss_of) -> list[list[Piece]]:
    """Sequences that are not full cut at powers of two, which need no padding."""
    out = []
    for pieces in bins:
        held = sum(p.length for p in pieces)
        if held == length:
            out.append(pieces)
            continue
        rest = list(reversed(pieces))
        while held:
            want, here = 1 << (held.bit_length() - 1), []
            held -= want
            while want:
                piece = rest.pop()
                if piece.length > want:
                    piece, after = piece.cut(want, loss_of)
                    rest.append(after)
                here.append(piece)
                want -= piece.length
            out.append(here)
    return out


def pack(sizes: list[int], length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, loss_of=None) -> list[list[Piece]]:
    """Sequences of pieces that hold each token of documents of ``sizes`` tokens once.

    ``loss_of(doc, start, length)`` counts the loss-bearing tokens of a stretch
    (default: all), of which a sequence holds at most ``loss`` (default: no more
    than its tokens).  A stretch of ``length`` tokens must not bear more.
    """
    loss = length if loss is None else loss
    loss_of = loss_of or (lambda doc, start, n: n)
    whole, tails = [], []
    for doc, size in enumerate(sizes):
        start = 0
        while size - start >= length and loss_of(doc, start, length) <= loss:
            whole.append([Piece(doc, start, length, loss_of(doc, start, length))])
            start += length
        while start < size:
            n = min(length, size - start)
            while loss_of(doc, start, n) > loss:
                n = max(1, n // 2)
            tails.append(Piece(doc, start, n, loss_of(doc, start, n)))
            start += n
    placed = fill(place(tails, length, segments, loss), length, segments, loss, loss_of)
    return whole + at_powers(placed, length, loss_of)


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, one lookup per white-space word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids in order.  Only characters that the tokenizer and this
    class both take as white space cut words here.  New words are encoded many
    at a time, with a mark between them whose ids are known.
    """

    MARK = "\x01"

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.cached = cached
        mark = self._ids(self.MARK)
        # A mark of several ids could not be told from a text's: then words are encoded one by one.
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.lean = self._lean(path)

    def _lean(self, path: str):
        """The same model for words of plain lower-case letters, without the steps that leave those as they are."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = tuple(
            [step["type"] for step in (spec.get(kind) or {}).get(many, [])]
            for kind, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        )
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            return None
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(spec))

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        tokenizer = tokenizer or self.tokenizer
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return np.array(encode([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        known = self.known
        plain = [w for w in words if self.mark is not None and self.MARK not in w]
        letters = [w for w in plain if w.isalpha() and w.islower() and not BEYOND_LATIN.search(w)] if self.lean else []
        self._learn_joined(letters, self.lean)
        self._learn_joined([w for w in plain if w not in known], self.tokenizer)
        for word in words:
            if word not in known:
                known[word] = self._ids(word).tobytes()

    def _learn_joined(self, words: list[str], tokenizer) -> None:
        for k in range(0, len(words), 500):
            part = words[k:k + 500]
            ids = self._ids(f" {self.MARK} ".join(part), tokenizer)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:
                raise ValueError("the tokenizer joins words across white space")
            raw = ids.tobytes()
            starts, ends = [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), len(raw)]
            for word, a, b in zip(part, starts, ends):
                self.known[word] = raw[a:b]

    def _add(self, words: list[str]) -> None:
        """Learn new words; closing points and commas after a letter are words of their own to the tokenizer."""
        known = self.known
        tailed, fresh = [], {}
        for word in words:
            if word not in known:
                core = word.rstrip(".,")
                if len(core) < len(word) and core[-1:].lower()[-1:].isalpha():
                    tailed.append((word, core))
                    word = word[len(core):]
                    fresh.update((w, None) for w in (core, word) if w not in known)
                else:
                    fresh[word] = None
        self._learn(list(fresh))
        for word, core in tailed:
            known[word] = known[core] + known[word[len(core):]]

    def encode(self, text: str) -> bytes:
        if text.isascii() or not BEYOND_LATIN.search(text):
            text = text.lower()  # the tokenizer does the same; for other scripts it is left to it
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > self.cached:
                known.clear()
            self._add(list(dict.fromkeys(words)))
            return b"".join([known[w] for w in words])


@cache
def tokens_of(path: str) -> WordTokens:
    """One tokenizer per Python worker: later tasks find the words it knows (about 200 bytes each)."""
    return WordTokens(path)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH, segments: int = SEGMENTS, keep_words: bool = True, answer_col: str | None = None, loss: int | None = None) -> DataFrame:
    """One row per piece of ``docs``, packed into sequences of at most ``length`` tokens.

    A document is its token ids and an end id; null text is empty, so it is the
    end id alone.  All tokens bear loss, unless ``answer_col`` names a second
    text (null: empty): then a document is its text, which bears none, the
    answer's ids and the end id, which do, and the rows tell their
    ``loss_tokens``.  A sequence holds at most ``loss`` tokens that bear loss
    (default: ``length``).  Each task packs blocks of about
    ``BLOCK_TOKENS`` tokens as it reads, so nothing is shuffled and memory is
    bounded; a block leaves no padding.  Repeated rows are packed each by
    itself, with their id; a null id stays null.  An empty table gives no rows.
    A Python worker keeps the tokenizer and the words it knows for later tasks
    if ``keep_words``: faster, but held as long as the worker lives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens_of(tokenizer) if keep_words else WordTokens(tokenizer, TASK_WORDS)
        end = np.array([END_ID], dtype="<u4").tobytes()
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 36
        ids: list[int | None] = []
        tokens: list[bytes] = []
        prompts: list[int] = []
        held = 0

        def bearing(doc: int, start: int, n: int) -> int:
            return max(0, start + n - max(start, prompts[doc]))

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            rows = []
            for sequence in pack([len(t) // 4 for t in tokens], length, segments, loss, bearing if answer_col else None):
                offset = 0
                for p in sequence:
                    ids_of = tokens[p.doc]
                    rows.append((ids[p.doc], p.start, p.length, zlib.crc32(ids_of[4 * p.start:4 * (p.start + p.length)]), len(ids_of) // 4, next_id, offset, p.loss)[:len(names)])
                    offset += p.length
                next_id += 1
            ids.clear()
            tokens.clear()
            prompts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for doc, text, answer in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2) if answer_col else repeat(None)):
                ids.append(doc)
                prompt = words.encode(text.as_py())
                prompts.append(len(prompt) // 4)
                tokens.append(prompt + (words.encode(answer.as_py()) if answer_col else b"") + end)
                held += len(tokens[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()
        if not keep_words:
            del words
        give_back()

    schema = SCHEMA + (", loss_tokens bigint" if answer_col else "")
    names = [c.split()[0] for c in schema.split(", ")]
    texts = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (answer_col, "answer")) if c]
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *texts).mapInArrow(run, schema)
