"""Hashed words, word fronts and byte statistics of texts for the classifiers. Inputs are texts alone."""

from __future__ import annotations

import numpy as np

from .textblocks import Block, distinct, mix, owners

BUCKETS = 1 << 18
_U = np.uint64
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def sparse(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, bucket): the distinct features of each text, its words without marks at their ends and their first 4 to 6 bytes."""
    _, start, length, ptr = block.words()
    owner = owners(ptr)
    buf = np.append(block.buf, np.zeros(8, np.uint8))
    end = start + length
    for _ in range(4):  # marks before and after a word
        start = start + ((start < end) & ~_ALNUM[buf[start]])
        end = end - ((end > start) & ~_ALNUM[buf[np.maximum(end - 1, 0)]])
    inside = np.append(np.cumsum(_VAL[buf].astype(np.uint64) * _POS(len(buf)), dtype=np.uint64), _U(0))
    whole = mix((inside[np.maximum(end, 1) - 1] - np.where(start > 0, inside[np.maximum(start, 1) - 1], _U(0))) * _INV(len(buf))[start])
    values, whose = [whole[end > start]], [owner[end > start]]
    front = np.zeros(len(start), np.uint64)
    for j in range(6):
        front = front * _U(257) + buf[start + j]
        if j >= 3:
            ok = end - start > j
            values.append(mix(front[ok] * _U(8) + _U(j)))
            whose.append(owner[ok])
    o, v, _ = distinct(np.concatenate(whose), np.concatenate(values) % _U(BUCKETS))
    return np.searchsorted(o, np.arange(block.n + 1)), v.astype(np.int64)


_VAL = mix(np.arange(256, dtype=np.uint64) + _U(77))


def _POS(n):
    from .textblocks import _powers

    return _powers(1 << max(16, (n - 1).bit_length()))[0][:n]


def _INV(n):
    from .textblocks import _powers

    return _powers(1 << max(16, (n - 1).bit_length()))[1][:n]


CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "space": range(9, 33), "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|\\/", "mark": b"#$%&*+=<>@^_~", "bracket": b"()[]{}\"'`-"}


def dense(block: Block) -> np.ndarray:
    """Statistics of each text (the block must be raw): shares of kinds of bytes, words, lines, repetition."""
    n = np.maximum(np.diff(block.ptr), 1)
    filled = np.flatnonzero(np.diff(block.ptr))
    out = []
    names = list(CLASSES)
    for at in range(0, len(names), 2):
        lut = np.zeros(256, np.uint64)
        for k, name in enumerate(names[at : at + 2]):
            lut[list(CLASSES[name])] += _U(1 << (32 * k))
        total = np.zeros(block.n, np.uint64)
        if len(filled):
            total[filled] = np.add.reduceat(lut[block.buf], block.ptr[:-1][filled])
        for k in range(len(names[at : at + 2])):
            out.append(((total >> _U(32 * k)) & _U(0xFFFFFFFF)) / n)
    words, _, length, ptr = block.words()
    count = np.maximum(np.diff(ptr), 1)
    owner = owners(ptr)
    o, _, _ = distinct(owner, words)
    out.append(np.bincount(o, minlength=block.n) / count)
    out.append(np.bincount(owner, length, block.n) / count / 10)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    o, _, _ = distinct(owner[pairs], mix(words[pairs] * _U(3) + words[pairs + 1]))
    out.append(np.bincount(o, minlength=block.n) / np.maximum(count - 1, 1))
    out.append(np.log1p(np.diff(ptr)) / 10)
    x = np.stack(out, 1)
    return np.concatenate([x, np.sqrt(x[:, : len(names)]), (x[:, : len(names)] > 0.02).astype(float)], 1)
