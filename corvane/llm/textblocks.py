"""Whole blocks of texts as NumPy arrays: words, their hashes, shingles.

A block is a slice of an Arrow string column of at most BLOCK_BYTES (or one longer text). All work on
it is vectorised; what a block needs in memory is some 60 bytes for each byte of text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of ``[^\x20\x09-\x0D]``.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


class Block:
    """buf: the texts' UTF-8 bytes without gaps, A-Z lowered unless raw; ptr: where each text starts, and the end."""

    def __init__(self, texts: pa.Array, raw: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.ptr = at - at[0]
        self.buf = whole[at[0] : at[-1]]
        if not raw:
            self.buf = _LOWER[self.buf]
        self.n = len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, length of each word; ptr: each text's first word, and the end)."""
        if not len(self.buf):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        inside = ~_SPACE[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.ptr[:-1][self.ptr[:-1] < len(self.buf)]
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, starts, np.zeros(self.n + 1, np.int64)
        size = 1 << max(16, (len(self.buf) - 1).bit_length())
        power, inverse = _powers(size)
        value = _VALUES[self.buf]
        value *= power[: len(self.buf)]
        value *= inside
        sums = np.add.reduceat(value, starts)
        sums *= inverse[starts]
        count = np.add.reduceat(inside, starts, dtype=np.int64)
        hashed = mix(sums ^ (count.astype(np.uint64) * _U(0xA0761D6478BD642F)))
        return hashed, starts, count, np.searchsorted(starts, self.ptr)


def blocks(batch: pa.RecordBatch, column: str = "text", raw: bool = False, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batch with at most so many bytes of text, or one text each."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        part = batch.slice(at, to - at)
        yield part, Block(part.column(part.schema.get_field_index(column)), raw)
        at = to


def owners(ptr: np.ndarray) -> np.ndarray:
    """The text of each element, from where each text's elements start."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs in order, with how often each occurs."""
    if not len(value):
        return owner, value, np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return o[at], v[at], np.diff(np.append(at, len(v)))


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each k-word shingle; a text of 1 to k-1 words has its whole sequence as one."""
    words, _, _, ptr = block.words()
    count = np.diff(ptr)
    here = np.maximum(count - k + 1, 0)
    owner = np.repeat(np.arange(block.n), here)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(ptr[:-1], here)
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + words[at + j])
    short = np.flatnonzero((count > 0) & (count < k))
    more = count[short].astype(np.uint64)
    for j in range(k - 1):
        has = count[short] > j
        word = words[np.where(has, ptr[short] + j, 0)] if len(short) else np.zeros(0, np.uint64)
        more = np.where(has, mix(more * _U(0x9FB21C651E98DF25) + word), more)
    return np.concatenate([out, more]), np.concatenate([owner, short])


def give_back() -> None:
    """Frees what a worker's allocators keep; workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def long(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column, dtype=np.int64))
