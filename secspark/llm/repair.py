"""Token output as Re-Pair grammars.

Documents are put in ascending id order over range partitions, encoded, and cut into shards of about
``SHARD_IDS`` ids. In each shard pairs of neighbouring ids are replaced by new symbols again and again,
until no pair occurs ``LEAST`` times: a rule takes 12 bytes (two symbols and a length) and each
replacement saves 4, so from the fourth on a rule pays. The shard keeps its rules, the remaining
sequence, and how many ids each symbol stands for, so any range of ids is decoded by a search in the
sums of those lengths.

A pass over the sequence replaces many pairs at once: at each place the pair that occurs more often than
both pairs it overlaps (ties: by the pair). The most frequent pair of all is replaced everywhere, so each
pass makes progress, and the passes end where one pair at a time would end: with no pair left.

File format: Parquet, one row a shard, columns
  part, shard      order of the shard: by part, then by shard
  doc_id, n_ids    lists, the documents of the shard in order
  rules            unsigned 32-bit little-endian pairs; rule r is symbol ``FIRST + r``
  lengths          unsigned 32-bit little-endian: ids that each rule stands for
  seq              unsigned 32-bit little-endian symbols
  total            ids in the shard
Spark's writer commits a task's file once, so a lost executor leaves no partial shard.

Defined results
- null text counts as empty: the document has the end id alone;
- null ids come first; rows with the same id are ordered by a hash of their text;
- a document larger than a shard is a shard of its own, with one grammar for every ``GRAMMAR_IDS`` ids of it
  (16 MB of text), which bounds a task's memory;
- extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty
from .substring import _slices
from .units import units

SHARD_IDS = 1 << 18
GRAMMAR_IDS = 1 << 22
SLICE_BYTES = 6 << 20
FIRST = 1 << 20  # above every token id, which is checked
LEAST = 4
_CELLS = 18
SCHEMA = "part int, shard int, doc_id array<long>, n_ids array<long>, rules binary, lengths binary, seq binary, total long"


def known(ids: np.ndarray) -> None:
    """Ids from ``FIRST`` on would be taken for rules."""
    if ids.max(initial=0) >= FIRST or ids.min(initial=0) < 0:
        raise ValueError(f"token ids must be under {FIRST}")


def _frequent(seq: np.ndarray, live: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs at ``live`` places that occur ``least`` times without overlapping themselves: places by pair, the pairs' keys, first places and counts."""
    keys = (seq[live] << bits) | seq[live + 1]
    # pairs in cells of a hash table: in a cell with too few of them none is frequent
    cell = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CELLS)).view(np.int64)
    some = np.flatnonzero((np.bincount(cell, minlength=1 << _CELLS) >= least)[cell])
    at, keys = live[some], keys[some]
    twin = np.flatnonzero((at[1:] == at[:-1] + 1) & (keys[1:] == keys[:-1])) + 1
    if len(twin):  # of a run of one symbol every second place counts
        start = np.concatenate(([True], np.diff(twin) != 1))
        first = twin[start][np.cumsum(start) - 1] - 1
        even = np.ones(len(at), dtype=bool)
        even[twin[(twin - first) % 2 == 1]] = False
        at, keys = at[even], keys[even]
    place = int(len(seq)).bit_length()
    if 2 * bits + place < 64:  # sorting key and place as one number is faster
        packed = (keys << place) | at
        packed.sort()
        keys, at = packed >> place, packed & ((1 << place) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else at
    return at, keys, first, np.diff(np.append(first, len(keys)))


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, sequence) of one grammar."""
    used = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    used[ids] = True
    terminals = np.flatnonzero(used)
    dense = np.cumsum(used) - 1  # ids as 0, 1, 2 ...; rules follow
    seq, m = dense[ids.astype(np.int64)], len(terminals)
    rules, lengths = [], [np.ones(m, dtype=np.int64)]
    made = made_as = np.zeros(0, dtype=np.int64)  # pairs that have a rule, sorted, and their symbols
    size = m
    # a pair that isn't frequent doesn't get so unless one of its symbols is made again: other places needn't be looked at
    live = np.arange(max(len(seq) - 1, 0))
    while len(live):
        bits = int(size).bit_length()
        at, key, first, counts = _frequent(seq, live, bits, least)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(counts[often], kind="stable")]
        rank = np.zeros(len(counts), dtype=np.int32)
        rank[often] = np.arange(1, len(often) + 1)
        ranks = np.zeros(len(seq) + 1, dtype=np.int32)  # of the pair at each place, with a zero at both ends
        ranks[at + 1] = np.repeat(rank, counts)
        here = ranks[1:-1]
        take = np.flatnonzero((here > ranks[:-2]) & (here > ranks[2:]))
        fine = np.bincount(here[take], minlength=len(often) + 1) >= least
        take = take[fine[here[take]]]
        pair = key[first[often[fine[1:]]]]
        pair = np.stack((pair >> bits, pair & ((1 << bits) - 1)), axis=1)
        # places that an earlier pass had to leave to another pair take the rule that is there
        code = (pair[:, 0] << 32) | pair[:, 1]
        near = np.minimum(np.searchsorted(made, code), max(len(made) - 1, 0))
        old = made[near] == code if len(made) else np.zeros(len(code), dtype=bool)
        symbol = np.where(old, made_as[near] if len(made) else 0, size + np.cumsum(~old) - 1)
        name = np.zeros(len(fine), dtype=np.int64)
        name[fine] = symbol
        seq[take] = name[here[take]]
        hot = here > 0
        hot[:-1] |= hot[1:]  # every second place of a run of one symbol has no rank
        hot[1:] |= hot[:-1]
        hot[take] = True
        hot[np.maximum(take - 1, 0)] = True
        pair = pair[~old]
        rules.append(pair)
        known = np.concatenate(lengths)
        lengths = [known, known[pair].sum(axis=1)]
        made, made_as = np.concatenate((made, code[~old])), np.concatenate((made_as, symbol[~old]))
        order = np.argsort(made, kind="stable")
        made, made_as = made[order], made_as[order]
        keep = np.ones(len(seq), dtype=bool)
        keep[take + 1] = False
        seq = seq[keep]
        hot = np.append(hot, False)[keep]
        if old.any():  # more of a symbol that was there before: its pairs may be frequent now
            again = np.zeros(size + len(pair), dtype=bool)
            again[symbol[old]] = True
            again = again[seq]
            hot |= again
            hot[:-1] |= again[1:]
        live = np.flatnonzero(hot[:-1])
        size += len(pair)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    symbols = np.concatenate((terminals, np.arange(FIRST, FIRST + size - m))).astype("<u4")
    return symbols[flat], np.concatenate(lengths)[m:].astype("<u4"), symbols[seq]


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for: each symbol's halves are put in their places, level by level."""
    symbol, sizes = seq.astype(np.int64), lengths.astype(np.int64)
    n = np.ones(len(symbol), dtype=np.int64)
    big = symbol >= FIRST
    n[big] = sizes[symbol[big] - FIRST]
    place = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype="<u4")
    while len(symbol):
        big = symbol >= FIRST
        out[place[~big]] = symbol[~big]
        pair, at = rules[symbol[big] - FIRST].astype(np.int64), place[big]
        left = np.ones(len(pair), dtype=np.int64)
        deep = pair[:, 0] >= FIRST
        left[deep] = sizes[pair[deep, 0] - FIRST]
        symbol, place = np.concatenate((pair[:, 0], pair[:, 1])), np.concatenate((at, at + left))
    return out


def decode_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a shard, expanding only the symbols that cover the range."""
    s = seq.astype(np.int64)
    ends = np.cumsum(np.where(s >= FIRST, lengths[np.maximum(s - FIRST, 0)] if len(lengths) else 1, 1).astype(np.int64))
    if start >= stop or not len(ends):
        return np.zeros(0, "<u4")
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    skip = start - (int(ends[i - 1]) if i else 0)
    return expand(seq[i : j + 1], rules, lengths)[skip : skip + stop - start]


def _write(path: str, end_id: int, shard_ids: int, grammar_ids: int):
    def row(part, shard, docs, ids):
        rules, lengths, seqs, done = [], [], [], 0
        for at in range(0, len(ids), grammar_ids):
            r, n, s = compress(ids[at : at + grammar_ids])
            shift = np.uint32(done)
            rules.append(np.where(r >= FIRST, r + shift, r))
            lengths.append(n)
            seqs.append(np.where(s >= FIRST, s + shift, s))
            done += len(r)
        raw = lambda x: np.concatenate(x).astype("<u4").tobytes()
        return {"part": part, "shard": shard, "doc_id": [d for d, _ in docs], "n_ids": [n for _, n in docs], "rules": raw(rules), "lengths": raw(lengths), "seq": raw(seqs), "total": len(ids)}

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("rules", pa.binary()), ("lengths", pa.binary()), ("seq", pa.binary()), ("total", pa.int64())])
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        encoder = units(path)
        part, shard, docs, held, size = None, 0, [], [], 0
        for whole in batches:
            for b in _slices(whole, "text", SLICE_BYTES):
                part = b["part"][0].as_py()
                ids, counts = encoder.encode(b["text"])
                known(ids)
                stops = np.cumsum(counts)
                for d, a, z in zip(b["doc_id"].to_pylist(), (stops - counts).tolist(), stops.tolist()):
                    docs.append((d, z - a + 1))
                    held += [ids[a:z], end]
                    size += z - a + 1
                    if size >= shard_ids:
                        yield pa.RecordBatch.from_pylist([row(part, shard, docs, np.concatenate(held))], schema)
                        shard, docs, held, size = shard + 1, [], [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([row(part, shard, docs, np.concatenate(held))], schema)

    return run


def write_shards(docs: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS, grammar_ids: int = GRAMMAR_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, compress and write ``docs``; returns the table of shards read back from its files.

    ``path`` names a byte-level BPE tokenizer; an id that the file format can't hold (``FIRST`` and above) raises ValueError.
    """
    known(np.array([end_id]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    parts = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return save(parts.mapInArrow(_write(path, end_id, shard_ids, grammar_ids), SCHEMA), "shards")


def _read(batches):
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b[c][i].as_py() for c in ("part", "shard", "doc_id", "n_ids", "rules", "lengths", "seq")}
            rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
            ids = expand(np.frombuffer(r["seq"], "<u4"), rules, np.frombuffer(r["lengths"], "<u4"))
            n = np.array(r["n_ids"], dtype=np.int64)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * m, pa.int32()), pa.array([r["shard"]] * m, pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the shards.

    ``start`` adds the ids of earlier parts, of earlier shards of the part, and of earlier documents of
    the shard; only one total a part is ordered in a single task.
    """
    zero = F.lit(0).cast("long")
    totals = shards.groupBy("part").agg(F.sum("total").alias("total"))
    parts = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("p"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "shard", F.coalesce(F.sum("total").over(own), zero).alias("s")).join(parts, "part")
    rows = shards.mapInArrow(_read, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("p") + F.col("s") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
