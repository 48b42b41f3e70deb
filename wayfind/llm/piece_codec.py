"""SentencePiece merge-type vocabularies: encoding by an agenda of symbol pairs, and decoding.

A text is its characters, with spaces shown as U+2581 and one put in front.  An
agenda holds the adjacent pairs whose join is a piece, best score first and
leftmost on a tie; the best pair is joined and its new neighbours enter.  What
is no piece in the end is spelled in bytes.  No piece of such a vocabulary holds
the space sign after another character, so a text falls into parts, each a run
of space signs and what follows; parts are encoded once per task and looked up
after that.  New parts of every Arrow batch are checked against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED_PARTS = 1_600_000
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class PieceModel:
    """The vocabulary of a model file, with its own encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [library.unk_id()] * 256
        self.end = library.eos_id()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.scores.append(library.get_score(i))
            if library.is_byte(i):
                value = int(BYTE_PIECE.fullmatch(piece)[1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif library.is_control(i):
                self.bytes_of.append(b"")
            elif library.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                self.ids[piece] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space sign after another character: texts can't be cut into parts")
        #: Pieces by falling score: what is joined first.
        self.place = {p: -self.scores[i] for p, i in self.ids.items()}
        #: Neighbours inside some piece; between any others a part can be cut without changing its ids.
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cores: dict[str, tuple[int, ...]] = {}
        self.text_of = [str(i).encode() for i in range(len(self.bytes_of))]
        #: Ids of known parts as text; and the decoded bytes of those that do not decode to themselves.
        self.parts: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part, its spaces already shown as signs."""
        ids, place, push, pop = self.ids, self.place, heapq.heappush, heapq.heappop
        symbols: list[str] = list(part)
        size = len(symbols)
        before, after = list(range(-1, size)), list(range(1, size + 1))
        after[-1:] = [-1]
        # the place of a pair's join in score order, the pair's left side, and the join
        agenda = [(place[j], k, j) for k, j in enumerate(map(str.__add__, symbols, symbols[1:])) if j in place]
        heapq.heapify(agenda)
        while agenda:
            _, left, join = pop(agenda)
            right = after[left]
            # a pair is stale when one of its sides has been joined meanwhile
            if right < 0 or not symbols[left] or len(symbols[left]) + len(symbols[right]) != len(join):
                continue
            symbols[left] = join
            symbols[right] = ""
            after[left] = right = after[right]
            if right >= 0:
                before[right] = left
                other = join + symbols[right]
                if other in place:
                    push(agenda, (place[other], left, other))
            left = before[left]
            if left >= 0:
                other = symbols[left] + join
                if other in place:
                    push(agenda, (place[other], left, other))
        out: list[int] = []
        at = 0 if size else -1
        while at >= 0:
            symbol = symbols[at]
            if symbol in ids:
                out.append(ids[symbol])
            else:
                out.extend([self.byte_ids[b] for b in symbol.encode()])
            at = after[at]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of some ids; the space put in front is taken away."""
        return self._shown(b"".join(self.bytes_of[i] for i in ids))

    @staticmethod
    def _shown(raw: bytes) -> bytes:
        raw = raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode()

    @staticmethod
    def split(text: str) -> list[str]:
        """The parts of a text, each without the sign of its last space.

        A part is a word, or a run of more space signs and the word after it;
        what is left at the end is a run of signs alone.
        """
        if not text:
            return []
        words = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
        if "" not in words:
            return words
        out, signs = [], ""
        for word in words[:-1]:
            if word:
                out.append(signs + word)
                signs = ""
            else:
                signs += SPACE
        return [*out, signs + words[-1]]

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, and hold each against the library."""
        # The library puts a space in front by itself; of an empty text it makes nothing.
        expected = self.library.encode(parts, num_threads=1)
        for part, theirs in zip(parts, expected):
            ours = self._encode_tailed(SPACE + part)
            if part and ours != theirs:
                raise ValueError(f"the library encodes {part!r} as {theirs}, not {ours}")
            self.parts[part] = b" ".join([self.text_of[i] for i in ours])
            raw = b"".join([self.bytes_of[i] for i in ours])
            if raw != b" " + part.replace(SPACE, " ").encode():
                self.odd[part] = raw

    def _encode_tailed(self, part: str) -> list[int]:
        """``encode_part``, with a word before its closing point or comma looked up by itself."""
        core = part.rstrip(".,")
        if core == part or not core or core[-1] + part[len(core)] in self.inside:
            return self.encode_part(part)
        if len(self.cores) > CACHED_PARTS // 2:
            self.cores.clear()
        out: list[int] = []
        for piece in (core, part[len(core):]):
            found = self.cores.get(piece)
            if found is None:
                found = self.cores[piece] = tuple(self.encode_part(piece))
            out.extend(found)
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        known = self.parts
        parts = self.split(text)
        try:
            coded = [known[p] for p in parts]
        except KeyError:
            if len(known) > CACHED_PARTS:
                known.clear()
                self.odd.clear()
            self.learn([p for p in dict.fromkeys(parts) if p not in known])
            coded = [known[p] for p in parts]
        coded.append(self.text_of[self.end])
        ids = b" ".join(coded)
        if self.odd and any(p in self.odd for p in parts):
            raw = self._shown(b"".join([self.odd.get(p) or b" " + p.replace(SPACE, " ").encode() for p in parts]))
        else:
            raw = text.replace(SPACE, " ").encode()
        return ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    def encode(self, text: str) -> list[int]:
        """All ids of a text and the end id."""
        return [i for part in self.split(text) for i in self.encode_part(SPACE + part)] + [self.end]


@cache
def model_of(path: str) -> PieceModel:
    """One model per Python worker: later tasks find the parts it knows."""
    return PieceModel(path)


def encoded_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Null text is the empty text: only the end id, and nothing to decode.  Rows
    are taken one by one, repeated ones and null ids as well.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = model_of(model)
        for texts in batches:
            yield pd.DataFrame([codec.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = docs.select(F.col(id_col).alias("doc_id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("r"))
    return coded.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its ``ids``, end id included, and the ``decoded`` text."""

    @F.pandas_udf("ids array<int>, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = model_of(model)
        for texts in batches:
            ids = [codec.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i).decode() for i in ids]})

    coded = docs.select(F.col(id_col).alias("doc_id"), code(F.coalesce(F.col(text_col), F.lit(""))).alias("r"))
    return coded.select("doc_id", "r.ids", "r.decoded")
