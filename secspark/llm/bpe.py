"""BPE encoding and decoding by tree concatenation.

A text of up to ``LEAF`` characters is a leaf of its own (:mod:`.units` calls the library for its distinct units). A longer text, unsplit runs
included, is cut in halves, again and again, until the pieces are that short. Each piece is a row of its
own, dealt over all tasks and encoded there with the offsets of its tokens. Neighbours are then joined
level by level: a window of text around the cut is encoded anew, twice as far each time, until at both
of its ends ``AGREE`` tokens in a row have the same ids and offsets as in the halves. What the halves have
outside of these places stands, between them the window's tokens do. A window that has reached both ends
is the text itself, so a join always settles.

Why that is exact: a sequence of tokens is what BPE gives for a text if each two neighbours are what it
gives for their own text, and every two neighbours of a join stand together either in a half or in the
window. Cuts and windows never part a character from its combining marks.

Defined results
- null text counts as empty: no tokens, the digest of the empty string;
- truncation and padding are off; no special tokens are added;
- repeated rows and null ids are kept as they are; extra columns are ignored; an empty table gives an
  empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save, text_or_empty
from .substring import _slices
from .units import tokenizer, units

LEAF = 1 << 16
#: Distinct units of which a worker keeps the ids, twice over.
UNITS = 120_000
WINDOW = 64
AGREE = 3
_HALF = "row long, n long, text string, starts array<int>, ends array<int>, ids array<int>"


@lru_cache(maxsize=4)
def _numerals(path: str) -> list[str]:
    return [str(i) for i in range(tokenizer(path).get_vocab_size(with_added_tokens=True))]


def encode_all(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def split(text: str, leaf: int) -> list[str]:
    """Halves of halves until each piece has at most ``leaf`` characters; marks stay with their character."""
    parts = 1
    while -(-len(text) // parts) > leaf:
        parts *= 2
    cuts = [0]
    for k in range(1, parts):
        at = max(cuts[-1], len(text) * k // parts)
        while at < len(text) and unicodedata.combining(text[at]):
            at += 1
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class Half:
    """A stretch of text with its tokens."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        self.text, self.starts, self.ends, self.ids = text, starts, ends, ids

    @classmethod
    def encoded(cls, t, text: str) -> Half:
        e = t.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return cls(text, at[:, 0], at[:, 1], np.array(e.ids, dtype=np.int64))

    def places(self, lo: int, hi: int, shift: int) -> dict[tuple, int]:
        """Where ``AGREE`` tokens in a row begin that lie between ``lo`` and ``hi``: shifted tokens to index.

        Only runs that begin with a new character count: tokens inside of one share their offsets.
        """
        a, b = np.searchsorted(self.starts, lo), np.searchsorted(self.ends, hi, side="right")
        row = list(zip((self.starts[a:b] + shift).tolist(), (self.ends[a:b] + shift).tolist(), self.ids[a:b].tolist()))
        before = [int(self.starts[a - 1]) + shift if a else -1, *[x[0] for x in row]]
        return {tuple(row[k : k + AGREE]): int(a) + k for k in range(len(row) - AGREE + 1) if row[k][0] != before[k]}


def join(t, left: Half, right: Half, window: int | None = None) -> Half:
    """The tokens of both texts as one."""
    mid, n = len(left.text), len(left.text) + len(right.text)
    reach = WINDOW if window is None else window
    while True:
        lo, hi = max(0, mid - reach), min(n, mid + reach)
        while lo > 0 and unicodedata.combining(left.text[lo]):
            lo -= 1
        while hi < n and unicodedata.combining(right.text[hi - mid]):
            hi += 1
        mine = Half.encoded(t, left.text[lo:] + right.text[: hi - mid])
        head = (0, 0) if lo == 0 else _first(mine.places(0, mid - lo - 1, lo), left.places(lo, mid - 1, 0))
        tail = (len(mine.ids), len(right.ids)) if hi == n else _first(mine.places(mid - lo + 1, hi - lo, lo), right.places(1, hi - mid, mid))
        if head and tail and head[0] <= tail[0]:
            break
        reach *= 2
    (a, k), (b, q) = head, tail
    pick = lambda x, y, z, s: np.concatenate((x[:k], y[a:b] + (lo if s else 0), z[q:] + (mid if s else 0)))
    return Half(left.text + right.text, pick(left.starts, mine.starts, right.starts, True), pick(left.ends, mine.ends, right.ends, True), pick(left.ids, mine.ids, right.ids, False))


def _first(window: dict, half: dict) -> tuple[int, int] | None:
    """(index in the window, index in the half) of the first place where both agree."""
    return next(((i, half[x]) for x, i in window.items() if x in half), None)


def encode_tree(path: str, text: str, leaf: int | None = None, window: int | None = None) -> list[int]:
    """The same in one process: ids of a text."""
    t, level = tokenizer(path), [Half.encoded(tokenizer(path), x) for x in split(text, LEAF if leaf is None else leaf)]
    while len(level) > 1:
        level = [join(t, *level[i : i + 2], window) for i in range(0, len(level), 2)]
    return level[0].ids.tolist()


def _split(leaf: int):
    def run(batches):
        for b in batches:
            for row, text in zip(b["row"].to_pylist(), b["text"]):
                pieces = split(text.as_py(), leaf)
                for at in range(0, len(pieces), 64):
                    part = pieces[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["row", "n", "text"])

    return run


def _batch(row: list[int], n: list[int], halves: list[Half]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array([h.text for h in halves], pa.string()), *[pa.array([getattr(h, c) for h in halves], ints) for c in ("starts", "ends", "ids")]],
        names=["row", "n", "text", "starts", "ends", "ids"],
    )


def _leaves(path: str):
    def run(batches):
        t = tokenizer(path)
        for whole in batches:
            for b in _slices(whole, "text"):
                yield _batch(b["row"].to_pylist(), b["n"].to_pylist(), [Half.encoded(t, x) for x in b["text"].to_pylist()])

    return run


def _join_rows(path: str, window: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["n"])
        halves = [Half(r["text"], *[np.array(r[c], dtype=np.int64) for c in ("starts", "ends", "ids")]) for r in rows]
        both = join(tokenizer(path), *halves, window) if len(halves) > 1 else halves[0]
        return pa.Table.from_batches([_batch([rows[0]["row"]], [rows[0]["n"] // 2], [both])])

    return run


def _long_ids(rows: DataFrame, path: str, leaf: int, window: int, longest: int) -> DataFrame:
    """row, ids of the texts of ``rows`` (row, text), all longer than a leaf."""
    pieces = rows.select("row", "text").mapInArrow(_split(leaf), "row long, n long, text string")
    level = pieces.repartition("row", "n").mapInArrow(_leaves(path), _HALF)
    parts = 1
    while -(-longest // parts) > leaf:
        parts *= 2
        pair = F.floor(F.col("n") / 2)
        level = level.groupBy("row", pair.alias("pair")).applyInArrow(_join_rows(path, window), _HALF)
    return level.select("row", "ids")


def encoded(docs: DataFrame, path: str, finish: Callable, kinds: str, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", leaf: int | None = None, window: int | None = None) -> DataFrame:
    """doc_id, the columns of ``carry`` and what ``finish`` makes of a batch's lists of ids (Arrow columns of ``kinds``)."""
    leaf, window = LEAF if leaf is None else leaf, WINDOW if window is None else window
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, text_or_empty(text_col).alias("text"))
    size = F.length("text")
    kept = ["doc_id", *carry]
    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept) + kinds

    def made(batch: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
        found = finish(ids)
        return pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *found.values()], names=[*kept, *found])

    def short(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "text"):
                ids, n = units(path, UNITS).encode(b["text"])
                stops, ids = np.cumsum(n), ids.tolist()
                yield made(b, [ids[z - k : z] for z, k in zip(stops.tolist(), n.tolist())])

    def long(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield made(b.slice(i, 1), [b["ids"][i].as_py()])

    out = rows.where(size <= leaf).mapInArrow(short, schema)
    longest = rows.agg(F.max(size)).first()[0] or 0
    if longest <= leaf:
        return out
    # written, so that the row numbers stay what they are when a task runs again
    held = save(rows.where(size > leaf).withColumn("row", F.monotonically_increasing_id()), "long")
    ids = save(_long_ids(held, path, leaf, window, longest), "ids")
    tree = save(held.select("row", *kept).join(ids, "row").mapInArrow(long, schema), "tree")
    drop(held, ids)
    return out.unionByName(tree)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), leaf: int | None = None, window: int | None = None) -> DataFrame:
    """doc_id, the columns of ``carry``, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""

    def finish(ids: list[list[int]]) -> dict[str, pa.Array]:
        text = tokenizer(path).decode_batch(ids, skip_special_tokens=False)
        numerals = _numerals(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        joined = [sha(" ".join([numerals[i] for i in x])) for x in ids]
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(joined, pa.string()), "decoded_sha256": pa.array([sha(x) for x in text], pa.string())}

    return encoded(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", carry, id_col, text_col, leaf, window)


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them."""

    def finish(ids: list[list[int]]) -> dict[str, pa.Array]:
        text = tokenizer(path).decode_batch(ids, skip_special_tokens=False)
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(text, pa.string())}

    return encoded(docs, path, finish, "ids array<int>, decoded string", id_col=id_col, text_col=text_col)
