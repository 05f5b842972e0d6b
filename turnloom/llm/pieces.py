"""Exact merge-type (BPE) piece encoding by backtracking, with byte fallback, and decoding.

The encoding of a text is the only sequence of pieces in which every two
neighbours, merged anew from their characters, come out as the same two pieces.
So it is found without a merge queue: take the longest piece at a position
(Aho-Corasick matches), keep it if it goes with the piece before it, else the
next shorter one, else step back; a bitfield marks positions from which the
rest was shown to have no answer.

No piece holds a word mark after another character, so merges never leave a run
of marks with the characters that follow it. Each such chunk is encoded once per
worker and remembered; the memory is emptied when it holds `MEMORY` chunks.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.arrays import Block, columns, per_block

MARK = "▁"
NEVER = float("-inf")
MEMORY = 600_000
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """The vocabulary of a piece model and the search over it."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.text: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(len(self.text)) if sp.is_byte(i)}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        self.unknown = sp.unk_id()
        special = {i for i in range(len(self.text)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.id_of = {p: i for i, p in enumerate(self.text) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece holds a word mark after another character; chunks would not be independent")
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.id_of))
        self._alone: dict[str, bool] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._known: dict[str, tuple[str, int, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces by merging best pairs, leftmost first: the definition, used on two pieces at a time."""
        parts, score = list(text), self.score
        pairs = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def alone(self, piece: str) -> bool:
        """Does the piece, or the character outside the vocabulary, come out whole by itself?"""
        known = self._alone.get(piece)
        if known is None:
            known = len(self.merged(piece)) == 1
            if piece in self.id_of:
                self._alone[piece] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MEMORY:
                self._fits.clear()
            known = self._fits[key] = self.merged(left + right) == [left, right]
        return known

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character outside the vocabulary is a piece of its own."""
        longest = [piece for _, piece in self.automaton.iter_long(chunk)]
        if len("".join(longest)) == len(chunk) and self.alone(longest[0]):
            rest = longest[1:]
            if all(map(self._fits.get, zip(longest, rest))) or all(map(self.fits, longest, rest)):
                return longest  # the longest matches, and each goes with the next
        n, id_of = len(chunk), self.id_of
        failed = 0
        path: list[str] = []
        stops = [min(n, self.longest)]  # by piece of the path, and the next one: the largest end to try
        at = 0
        while at < n:
            stop, piece = stops[-1], ""
            while stop > at:
                option = chunk[at:stop]
                if (option in id_of or stop == at + 1) and not failed >> stop & 1:
                    if self.fits(path[-1], option) if path else self.alone(option):
                        piece = option
                        break
                stop -= 1
            if piece:
                stops[-1] = stop - 1
                path.append(piece)
                at = stop
                stops.append(min(n, at + self.longest))
            else:
                if not path:
                    raise ValueError("no encoding; the vocabulary is not of the merge type")
                stops.pop()
                failed |= 1 << at  # nothing that starts here goes with the only piece that can end here
                at -= len(path.pop())
        return path

    def ids(self, piece: str) -> list[int]:
        known = self.id_of.get(piece)
        if known is not None:
            return [known]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        """(",id,id", number of ids, decoded text) of a chunk."""
        known = self._known.get(chunk)
        if known is None:
            if len(self._known) >= MEMORY:
                self._known.clear()
            found = self.split(chunk)
            ids = [self.id_of.get(p, -1) for p in found]
            if -1 in ids:
                ids = [i for p in found for i in self.ids(p)]
            known = self._known[chunk] = ("," + ",".join(map(str, ids)), len(ids), self.decode(ids))
        return known

    def decode(self, ids: list[int]) -> str:
        """Text of the ids with marks as spaces; runs of byte pieces as UTF-8, each bad byte as U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(self.text[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out).replace(MARK, " ")

    def encode(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        known = [self.chunk(c) for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        decoded = "".join([k[2] for k in known])
        return "".join([k[0] for k in known])[1:], sum([k[1] for k in known]), decoded[1:]  # without the mark put in front


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return _utf8_slowly(bytes(raw))


def _utf8_slowly(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """One vocabulary per worker process and model file."""
    return Pieces(model)


def encode_pieces(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """`n_tokens`, digests of the ids and of the decoded text for each document, `ids` too if asked for.

    docs(doc_id, text). A null text is encoded as the empty one: no ids. Every
    input row gives one row; other columns of `docs` are not carried along.
    `model` is a file that every executor can read.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def work(block: Block) -> pa.RecordBatch:
        vocabulary = pieces(model)
        rows = [vocabulary.encode(t) for t in block.texts()]
        more = {"ids": pa.array([[int(x) for x in r[0].split(",")] if r[0] else [] for r in rows], pa.list_(pa.int32()))} if keep_ids else {}
        return columns(
            block, ["doc_id"], n_tokens=np.array([r[1] for r in rows], np.int64),
            ids_sha256=pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string()),
            decoded_sha256=pa.array([hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()), **more,
        )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_block(work), schema)
