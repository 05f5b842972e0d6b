"""Byte-level BPE ids of many texts: every distinct chunk is encoded once per worker.

A chunk is one space with the non-space run after it, a bare run, or white
space; a run is cut where its first letters and digits end at punctuation. The
vocabulary's own word pattern never joins characters of two chunks.
New chunks of a block go through the tokenizer library together, as lines of
one text, and are told apart by the bytes each id stands for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ÿ"  # letters and digits, some of them
_CHUNKS = re.compile(rf" ?[{LETTERS}]++(?:(?=[!-/:-@\[-`{{-~])|[^{WHITE}]*)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
MEMORY = 250_000  # chunks that a worker remembers, about 260 bytes each; it holds them while it is idle, too


class ByteIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in chunks, names of special ids are plain text
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = np.zeros(self.size, np.int64)  # in the vocabulary each character is one byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self._known: dict[str, bytes] = {}
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)  # fast: no offsets

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """The memory, holding all given chunks."""
        wanted = set(chunks)
        new = wanted.difference(self._known)
        if new and len(self._known) + len(new) > MEMORY:  # those that are wanted now are the ones likely to come again
            self._known = {c: self._known[c] for c in wanted.difference(new)}
        lines = [c for c in new if not (c[-1:].isspace() or c[:1].isspace() and (c[0] != " " or c[1:2].isspace()) or not c)]
        for c in new.difference(lines) if len(lines) < len(new) else ():
            self._known[c] = self._plain(c).tobytes()
        if lines:
            text = "\n".join(lines)
            ids = self._plain(text)
            ends = np.cumsum(self.bytes[ids])
            feeds = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8) == 10)  # no line holds one
            stops = np.searchsorted(ends, feeds) + 1
            raw, to = ids.tobytes(), (4 * stops).tolist()
            self._known.update(zip(lines, [raw[x:y] for x, y in zip([0, *[y + 4 for y in to[:-1]]], to)]))  # over the line feeds
        return self._known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, as the library gives them.

        A text that holds the name of a special id goes to the library as a whole.
        """
        named = {i for i, t in enumerate(texts) if any(n in t for n in self.names)}
        split = [[] if i in named else _CHUNKS.findall(t) for i, t in enumerate(texts)]
        known = self.learn(set().union(*split))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        self.tokenizer.encode_special_tokens = False  # names of special ids are these ids here
        for i in named:
            out[i] = self._plain(texts[i]).tobytes()
        self.tokenizer.encode_special_tokens = True
        return out


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    """One tokenizer per worker process and file."""
    return ByteIds(path)
