"""Vectorised word work on Arrow text columns, used inside ``mapInArrow`` tasks.

A *block* is a run of rows whose texts hold at most ``BLOCK_BYTES`` (a longer
text is a block of its own), so the numpy arrays of a task stay small however
many rows an Arrow batch has. Words are maximal runs of ASCII letters, digits,
underscores and non-ASCII characters; each gets a 64-bit polynomial hash of its
bytes, computed for all words of a block from one running sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 16
_KEPT_BYTES = 1 << 18      # the longest block that an operator asks for, whose powers are kept

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_FOLD = np.zeros(256, np.uint8)          # lower-cased byte of a word, 0 between words
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum() or _c == ord("_"):
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process up to the longest block (2 MB)."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, _KEPT_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == _KEPT_BYTES + 1:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))


def give_back() -> None:
    """Freed memory of this process goes back to the system: what the allocators keep counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not glibc
        pass


def lean(run):
    """``run`` for ``mapInArrow``, after whose last batch the worker gives freed memory back: Spark uses
    its workers again for other stages."""
    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


@dataclass
class Block:
    """Rows ``first..first+n`` of a batch: their bytes and where each text starts."""

    first: int
    data: np.ndarray        # uint8, all texts one after another
    offsets: np.ndarray     # int64, n + 1 byte offsets into data

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_blocks(col: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if len(col) == 0:
        return
    _, off, buf = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield Block(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a block in text order."""

    hash: np.ndarray        # uint64 per word
    start: np.ndarray       # byte offset in the block
    end: np.ndarray
    bounds: np.ndarray      # n + 1 word offsets: words of row i are bounds[i]:bounds[i+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(b: Block) -> Words:
    folded = _FOLD[b.data]
    inside = np.zeros(len(folded) + 1, bool)
    inside[:-1] = folded != 0
    before = np.zeros(len(folded) + 1, bool)
    before[1:] = inside[:-1]
    cut = b.offsets[:-1]
    cut = cut[cut < len(folded)]
    opens, closes = inside & ~before, before & ~inside
    joint = cut[inside[cut] & before[cut]]      # a word must not run over into the next text
    opens[joint] = closes[joint] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    run = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded * _power("up", _BASE, len(folded)), out=run[1:])
    h = (run[end] - run[start]) * _power("down", _BASE_INV, len(folded) + 1)[start]
    return Words(mix(h), start, end, np.searchsorted(start, b.offsets))


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their n + 1 bounds per row. A row of
    1 to k-1 words has one gram of all its words; a row without words has none."""
    n = w.counts
    full = np.maximum(n - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), full)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full) + w.bounds[rows]
    h = np.zeros(len(rows), np.uint64)
    for j in range(k):
        h += w.hash[at + j] * _WEIGHTS[j]
    h = mix(h)
    short = np.flatnonzero((n > 0) & (n < k))
    bounds = np.zeros(len(n) + 1, np.int64)
    bounds[1:] = np.cumsum(full + ((n > 0) & (n < k)))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            ok = n[short] > j
            sums[ok] += w.hash[w.bounds[short[ok]] + j] * _WEIGHTS[j]
        out = np.empty(bounds[-1], np.uint64)
        one = np.zeros(len(out), bool)
        one[bounds[short]] = True
        out[one], out[~one] = mix(sums + n[short].astype(np.uint64)), h
        h = out
    return h, bounds
