"""Vectorised hashes of words and word windows over whole Arrow batches (numpy, bounded memory).

A word is a run of bytes other than space and 0x09-0x0D. Word hashes are polynomial sums over the
bytes, mixed to 64 bits; window hashes are polynomial sums over the mixed word hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19
_MASK = (1 << 64) - 1


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * _BLOCK
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """Words of a batch of texts: byte spans, hashes, and the text each word belongs to."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        data = data[off[0] : off[-1]]
        off = off - off[0]
        if texts.null_count:  # a null has an empty span
            pass
        self.data = _LOWER[data] if lower else data
        word = ~_SPACE[self.data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[off] = True
        before = np.concatenate(([False], word[:-1])) & ~first[:-1]
        after = np.concatenate((word[1:], [False])) & ~first[1:]
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.text = np.searchsorted(off, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=n)[:n] if n else np.zeros(0, dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        s, e = self.starts, self.ends
        out = np.zeros(len(s), dtype=np.uint64)
        long = np.flatnonzero(e - s > _BLOCK)
        up, down = _powers()
        i = 0
        while i < len(s):
            if e[i] - s[i] > _BLOCK:
                out[i] = int.from_bytes(hashlib.blake2b(self.data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
                i += 1
                continue
            j = int(np.searchsorted(s, s[i] + _BLOCK - 1, side="right"))
            k = np.searchsorted(long, i)
            if k < len(long):
                j = min(j, int(long[k]))
            base, top = int(s[i]), int(e[j - 1])
            if top - base > 2 * _BLOCK - 1:  # not reached: a word of the range has _BLOCK bytes at most
                raise AssertionError("word range too long")
            sums = np.zeros(top - base + 1, dtype=np.uint64)
            np.cumsum((self.data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
            a, b = s[i:j] - base, e[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            i = j
        return mix(out)

    def same_text(self, k: int) -> np.ndarray:
        """For each start of k consecutive words: are they all of one text?"""
        n = len(self.text) - k + 1
        return self.text[:n] == self.text[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def rolling(h: np.ndarray, k: int, mult: int) -> np.ndarray:
    """Polynomial hash of every k consecutive values, built by doubling; not mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, part, width = None, 0, h, 1
    bits = k
    while bits:
        if bits & 1:
            piece = part[done : done + n] if out is not None else part[:n]
            out = piece if out is None else out * np.uint64(pow(mult, width, 1 << 64)) + piece
            done += width
        bits >>= 1
        if bits:
            part = part[: len(part) - width] * np.uint64(pow(mult, width, 1 << 64)) + part[width:]
            width *= 2
    return out


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every w consecutive values."""
    if len(x) < w:
        return x[:0]
    part, width = x, 1
    while width * 2 <= w:
        part = f(part[: len(part) - width], part[width:])
        width *= 2
    n = len(x) - w + 1
    return f(part[:n], part[w - width : w - width + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
