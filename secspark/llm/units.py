"""BPE ids of whole batches, each distinct unit encoded once.

A unit is a stretch of bytes that the pre-tokenizer (contractions; letters, digits or other signs; white
space) never joins with its neighbours. Texts are cut into units by comparing bytes in numpy, Arrow finds
the distinct ones, the library encodes those that a bounded cache doesn't hold, and Arrow puts the ids in
the order of the texts. Cutting less is always right, so bytes of rarer scripts simply stay together.

Two kinds of tokenizer are known: byte-level ones, where a space belongs to the word behind it, and those
with a sign for the end of a word, which drop white space.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa


CACHE = 900_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_END = "\n"


_WHITE, _SPACE, _VISIBLE, _LETTER, _SIGN, _QUOTE, _TWO, _THREE = (1 << k for k in range(8))


def _classes() -> np.ndarray:
    """Classes of a byte, as bits."""
    out = np.zeros(256, dtype=np.uint8)
    for bit, spans in (
        (_WHITE, [(0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20)]),
        (_SPACE, [(0x20, 0x20)]),
        (_VISIBLE, [(0x21, 0x7E)]),
        (_LETTER, [(0x41, 0x5A), (0x61, 0x7A)]),
        (_SIGN, [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)]),
        (_QUOTE, [(0x27, 0x27)]),
        # leading bytes of characters of two and three bytes whose blocks hold no white space
        (_TWO, [(0xC3, 0xDF)]),
        (_THREE, [(0xE0, 0xE0), (0xE4, 0xEF)]),
    ):
        for a, b in spans:
            out[a : b + 1] |= bit
    return out


_CLASSES = _classes()
#: A unit that stands alone between line ends: visible signs with at most one space in front.
_GLUED = re.compile(rb" ?(?=[!-~\xc3-\xdf])[!-~\x80-\xff]*(?:[!-~]|[\xc3-\xdf][\x80-\xbf])")
#: The same where white space is dropped: no sign whose lower case or normal form has another length.
_BARE = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")


def cuts(data: np.ndarray, starts: np.ndarray, glued: bool = True) -> np.ndarray:
    """For each byte: does a unit begin before it for sure? ``starts`` are those of the texts."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return cut
    kind = _CLASSES[data]
    p, c, high = kind[:-1], kind[1:], data[:-1] >= 0x80
    last = np.concatenate((kind[:1], kind[:-2]))  # of the byte before p
    white = (kind & _WHITE) != 0
    begins = (kind & (_VISIBLE | _TWO | _THREE)) != 0
    ends = ((p & _VISIBLE) != 0) | (high & ((last & _TWO) != 0))
    begins[starts] = False  # what follows a text's last byte is no part of it
    follows = np.concatenate((begins[2:], [False]))
    latin = high & (np.concatenate((data[:1], data[:-2])) == 0xC3) & (data[:-1] != 0x97) & (data[:-1] != 0xB7)
    cut[1:] = (
        (white[1:] & (ends | (white[:-1] & follows)))  # white space after a visible character, the last white space of several
        | (((p & ((_WHITE | _SPACE) if glued else _WHITE)) == _WHITE) & begins[1:])  # a character after a line end or tab
        | (((c & _SIGN) != 0) & (((p & _LETTER) != 0) | latin))  # a sign after a letter
        | (((p & (_SIGN | _QUOTE)) == _SIGN) & ((c & _LETTER) != 0))  # a letter after a sign that opens no contraction
    )
    return cut


class Units:
    """An encoder for texts of a worker process."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = tokenizer(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [x.encode() for x in special]
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.glued = not suffix
        self.alone = _GLUED if self.glued else _BARE
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for x, i in vocab.items():
            self.sizes[i] = len(x.removesuffix(suffix))  # one character of the vocabulary stands for a byte
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        """Start a new generation; the last one stays at hand."""
        kept = getattr(self, "young", {})
        if kept:
            rows = pa.array(np.fromiter(kept.values(), np.int64, len(kept)))
            self.lists = [self._table().take(rows)]
        else:
            self.lists = []
        self.old, self.young, self.size = dict(zip(kept, range(len(kept)))), {}, len(kept)

    def _table(self) -> pa.Array:
        """Ids of every unit that either generation knows."""
        if len(self.lists) > 1:
            self.lists = [pa.concat_arrays(self.lists)]
        return self.lists[0]

    def _add(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.young.update(zip(units, range(self.size, self.size + len(units))))
        self.size += len(units)
        self.lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids)))

    def _apart(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in one call: line ends keep them apart, and byte counts tell which ids are whose."""
        text = _END.join([u.decode() for u in units])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.cumsum(self.sizes[ids])
        stops = np.cumsum([len(u) + self.glued for u in units]) - self.glued
        last = np.searchsorted(ends, stops)
        if not (ends[np.minimum(last, len(ends) - 1)] == stops).all():
            raise ValueError("a unit was joined with its neighbour")
        if not self.glued:
            return ids, np.diff(last, prepend=-1)
        keep = np.ones(len(ids), dtype=bool)
        keep[last[:-1] + 1] = False  # the line ends
        return ids[keep], np.diff(last, prepend=-2) - 1

    def _whole(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def learn(self, units: list[bytes]) -> np.ndarray:
        """Rows of distinct units in the table of ids."""
        if len(self.young) > self.cache:
            self._forget()
        missing = [u for u in units if u not in self.young]
        if self.old and missing:
            again = [(u, k) for u in missing if (k := self.old.get(u)) is not None]
            self.young.update(again)
            missing = [u for u in missing if u not in self.young]
        apart = [u for u in missing if self.alone.fullmatch(u)]
        for at in range(0, len(apart), 1024):
            self._add(apart[at : at + 1024], *self._apart(apart[at : at + 1024]))
        other = [u for u in missing if u not in self.young] if len(apart) < len(missing) else []
        for at in range(0, len(other), 1024):
            self._add(other[at : at + 1024], *self._whole(other[at : at + 1024]))
        return np.fromiter(map(self.young.__getitem__, units), np.int64, len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        off = off - off[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        whole = data.tobytes()
        begin = cuts(data, off[off < len(data)], self.glued)
        for x in self.special:  # the library looks for special tokens first: a text with one is a unit
            at = whole.find(x)
            while at >= 0:
                k = np.searchsorted(off, at, side="right") - 1
                begin[off[k] : off[k + 1]] = False
                at = whole.find(x, int(off[k + 1]))
        begin[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        bounds = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).dictionary_encode()
        rows = pa.array(self.learn(units.dictionary.to_pylist())).take(units.indices)
        found = self._table().take(rows)
        per_unit = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy().astype(np.int64))))
        return found.flatten().to_numpy(zero_copy_only=False), np.diff(per_unit[np.searchsorted(starts, off)])


@lru_cache(maxsize=2)
def units(path: str, cache: int = CACHE) -> Units:
    """One for each worker process."""
    return Units(path, cache)
