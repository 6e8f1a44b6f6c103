"""Blocks of integer vectors: what the operators on embeddings share.

A component x becomes floor(256 * x), x as double. Rows whose vector is null, or holds a null or non-finite component, take no
part. Rows are packed into blocks, one row of a table each: the ids, the vectors as bytes of one integer type, and the
longest vector's length. A row is known by its block and place in it, as ids may be null or occur twice.

Two sets of blocks meet in tiles by an equi-join on a stripe: the stripes deal out one side's blocks, and each block of the
other side is sent to every stripe once. A stripe holds ``BLOCKS_IN_STRIPE`` blocks, so a task's share doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE = 256
#: Rows of a block at most, and blocks that share a stripe.
BLOCK, BLOCKS_IN_STRIPE = 2048, 16
BLOCKS = "block long, dim int, part string, n int, ids array<long>, kind string, vectors binary, longest double"
_PLACES = 16


def usable(vectors: DataFrame, id_col: str, vec_col: str, part: Column | None = None) -> DataFrame:
    """id, part (null: none), vector (array<double>), length2 of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.lit("") if part is None else part.cast("string")).alias("part"), v.alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.col("part").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.withColumn("length2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))


def integers(values: np.ndarray) -> tuple[str, np.ndarray]:
    """Whole numbers held as doubles in the smallest type that has them."""
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, values.astype(kind)


def matrix(row: dict) -> np.ndarray:
    """The vectors of a block as doubles, which hold them exactly."""
    return np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(row["n"], row["dim"]).astype(np.float64)


def keys(row: dict) -> np.ndarray:
    return (row["block"] << _PLACES) + np.arange(row["n"], dtype=np.int64)


def _pack(size: int, scale: float):
    def flush(number: int, dim: int, part: str, ids: list, vectors: list) -> pa.RecordBatch:
        whole = np.concatenate(vectors).reshape(len(ids), dim)
        kind, ints = integers(whole)
        longest = float(np.sqrt((whole * whole).sum(axis=1)).max(initial=0.0)) if dim else 0.0
        cells = [[number], [dim], [part], [len(ids)], [ids], [kind], [ints.tobytes()], [longest]]
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, (c[0] for c in cells)))], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 24
        held, ids, vectors = None, [], []
        for b in batches:
            dims = b["vector"].value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(b["vector"].flatten().to_numpy(zero_copy_only=False) * scale)
            at, names, parts = np.concatenate(([0], np.cumsum(dims))), b["id"].to_pylist(), b["part"].to_pylist()
            for i, group in enumerate(zip(dims.tolist(), parts)):
                if ids and (group != held or len(ids) == size):
                    yield flush(number, *held, ids, vectors)
                    number, ids, vectors = number + 1, [], []
                held = group
                ids.append(names[i])
                vectors.append(flat[at[i] : at[i + 1]])
        if ids:
            yield flush(number, *held, ids, vectors)

    return run


_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("part", pa.string()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("vectors", pa.binary()), ("longest", pa.float64())])
_NAMES = _SCHEMA.names


def packed(rows: DataFrame, size: int = BLOCK, scale: float = SCALE) -> DataFrame:
    """Blocks of one part and dimension, longest vectors first; the order of ids that tie keeps one vector's copies apart."""
    if not 0 < size <= 1 << _PLACES:
        raise ValueError(f"a block has 1 to {1 << _PLACES} rows")
    order = [F.col("part"), F.size("vector"), F.desc("length2"), F.xxhash64("id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "part", "vector")
    return save(dealt.mapInArrow(_pack(size, scale), BLOCKS), "blocks")


def chosen(blocks: DataFrame, modulus: int, size: int) -> DataFrame:
    """Blocks of the rows whose id is divisible by ``modulus``; ``places`` are their keys among all rows."""
    schema = _SCHEMA.append(pa.field("places", pa.list_(pa.int64())))

    def run(batches):
        for b in batches:
            held: dict[tuple, list] = {}
            for row in b.to_pylist():
                at = [i for i, x in enumerate(row["ids"]) if x is not None and x % modulus == 0]
                if at:
                    held.setdefault((row["dim"], row["part"]), []).append((row["block"], [row["ids"][i] for i in at], matrix(row)[at], keys(row)[at]))
            for (dim, part), found in held.items():
                ids = [x for f in found for x in f[1]]
                vectors, places = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
                for i in range(0, len(ids), size):
                    kind, ints = integers(vectors[i : i + size])
                    longest = float(np.sqrt((vectors[i : i + size] ** 2).sum(axis=1)).max(initial=0.0))
                    # the first row's key is a number that no other block of chosen rows has
                    cells = dict(zip(_NAMES, (int(places[i]), dim, part, len(ints), ids[i : i + size], kind, ints.tobytes(), longest)))
                    yield pa.RecordBatch.from_pylist([cells | {"places": places[i : i + size].tolist()}], schema=schema)

    return save(blocks.mapInArrow(run, BLOCKS + ", places array<long>"), "chosen")


def striped(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with a stripe, and the number of stripes."""
    stripes = max(1, -(-blocks.count() // BLOCKS_IN_STRIPE))
    return blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes))), stripes


def tiles(queries: DataFrame, blocks: DataFrame, condition: Column) -> DataFrame:
    """(q, c): query blocks and blocks of the same dimension for which the condition on ``q`` and ``c`` holds."""
    dealt, stripes = striped(blocks)
    q = queries.select(F.struct(*queries.columns).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"))
    c = dealt.select(F.struct(*blocks.columns).alias("c"), "stripe")
    return q.join(c, "stripe").where((F.col("q.dim") == F.col("c.dim")) & condition).select("q", "c")


def product(a: np.ndarray, b: np.ndarray, counts: np.ndarray | bool = True) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (whole numbers) as int64; by Python's integers where doubles can't hold them.

    Those that don't count may be wrong beyond 64 bits.
    """
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return fitting(whole(a) @ whole(b).T, counts)


def fitting(scores: np.ndarray, counts: np.ndarray | bool = True) -> np.ndarray:
    """Python's integers as int64; zero where one that doesn't count passes 64 bits."""
    beyond = (scores >= 1 << 63) | (scores < -(1 << 63)) if scores.size else np.zeros(scores.shape, dtype=bool)
    if (beyond & counts).any():
        raise OverflowError("an inner product passes 64 bits")
    return np.where(beyond, 0, scores).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by score downwards, then ident, then key."""
    order = np.lexsort((key, ident, -score, group))
    g = group[order]
    start = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, dtype=bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else g
    return order[rank < k]


#: Ids with null last.
def ranked_ids(ids: list) -> np.ndarray:
    return np.array([(1 << 63) - 1 if x is None else x for x in ids], dtype=np.int64)
