"""Words, lines and their hashes for a block of texts at once, straight from the Arrow buffers.

A block is a slice of an Arrow batch of bounded size, so memory does not follow
the batch size of the session. Hashes are 64 bits of a polynomial over the
bytes; two different strings meet with a chance of about 2^-60.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_TRIM, _OPTION = (getattr(ctypes.CDLL(None), name, None) for name in ("malloc_trim", "mallopt"))  # other C libraries have none

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E6C63D0876A9A35 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


class Block:
    """The texts of one slice: `data` (bytes), `offs` (n + 1 bounds), null texts empty."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text"):
        self.batch = batch
        texts = batch.column(column).cast(pa.large_binary())
        self.n = len(texts)
        self.is_null = np.asarray(texts.is_null())
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[offs[0] : offs[-1]]
        self.offs = offs - offs[0]

    def text(self, i: int) -> str:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")

    def texts(self) -> list[str]:
        return [self.text(i) for i in range(self.n)]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of each longest run of marked bytes; runs end with their text."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        full = self.offs[1:] > self.offs[:-1]
        before = np.concatenate(([False], inside[:-1]))
        before[self.offs[:-1][full]] = False
        after = np.concatenate((inside[1:], [False]))
        after[self.offs[1:][full] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return self.owner(starts), starts, ends

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, positions, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of all lines, split at line feeds."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate((self.offs[:-1], cuts + 1))
        ends = np.concatenate((cuts, self.offs[1:]))
        texts = np.concatenate((np.arange(self.n), self.owner(cuts)))
        order = np.lexsort((starts, texts))
        last = np.concatenate((self.owner(cuts), np.arange(self.n)))
        return texts[order], starts[order], ends[np.lexsort((ends, last))]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hash of each byte range, A-Z folded or not."""
        up, down = _powers(len(self.data) + 1)
        values = _BYTE[LOWER[self.data] if lower else self.data]
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]


def grams(hashes: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of k words inside one text."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(texts[:m] == texts[k - 1 :])
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total += hashes[at + j] * _ODD[j]
    return at, mix(total)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence of words (shorter than a gram)."""
    return mix(np.array([len(hashes)], np.uint64) + (hashes * _ODD[: len(hashes)]).sum(dtype=np.uint64))


def reuse_memory() -> None:
    """For steps that free and take some MB again and again: the process keeps up to 32 MB of it, the C library's own choice once arrays of 16 MB were freed."""
    if _OPTION:
        _OPTION(-3, 16 << 20)  # M_MMAP_THRESHOLD
        _OPTION(-1, 32 << 20)  # M_TRIM_THRESHOLD


def release_memory() -> None:
    """Freed memory goes back to the system: Spark keeps its idle workers, and they would hold it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of the batches with about `limit` bytes of text; a longer text is a block of its own. Behind the last one, freed memory goes back."""
    batch = whole = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = Block(batch, column)
        at = 0
        while at < whole.n:
            stop = int(np.searchsorted(whole.offs, whole.offs[at] + limit, "right")) - 1
            stop = min(max(stop, at + 1), whole.n)
            yield Block(batch.slice(at, stop - at), column)
            at = stop
    del batch, whole
    release_memory()


def columns(block: Block, names: Iterable[str], **more: np.ndarray | pa.Array) -> pa.RecordBatch:
    """The named columns of the block beside new ones."""
    fields = {c: block.batch.column(c) for c in names}
    fields |= {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in more.items()}
    return pa.RecordBatch.from_pydict(fields)


def per_block(work: Callable[[Block], pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES):
    """A function for `mapInArrow` that works block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column, limit):
            yield work(block)

    return run
