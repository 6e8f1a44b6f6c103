"""Exact top-k inner products over vectors sorted by length.

Blocks of vectors (:mod:`secspark.llm.vectors`) are in the order of falling length. Every query first meets the blocks of the
longest vectors, which gives it a score that its k-th best must reach. A block whose longest vector c can't reach it by
Cauchy-Schwarz (|q| * |c| under that score, for every query of a query block) is never sent to that query block. Inside a tile
vectors are turned by the right singular vectors of all vectors, so that the leading components hold most of a product:
after each stretch of components the rest is bounded by |q rest| * |c rest|, pairs that can't reach the score are given up,
and what is left is multiplied exactly in whole numbers. The score rises from one part of a block to the next.

The rotation is dimension x dimension numbers, summed by Spark and gathered on the driver; nothing else is. It only
decides how early pairs are given up: bounds carry a margin above rounding errors, scores are exact.

Defined results
- vectors null, or with a null or non-finite component, take no part; vectors of another dimension than the query's are no candidates of it;
- a query's own row is no candidate; another row with the same id is one, and each row of a query's id is a query of its own;
- a candidate without an id counts as the largest id among ties; a row without an id is no query;
- ties go to the smaller id, then to the row that comes first in the blocks;
- an inner product beyond 64 bits raises OverflowError; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch
from .vectors import BLOCK, SCALE, best, chosen, keys, matrix, packed, product, ranked_ids, tiles, usable

#: Rows of a query block, blocks of the longest vectors that give the first scores, rows of a part of a block.
QUERIES, HEAD, PART = 1024, 4, 512
_OUT = "place long, query_id long, id long, key long, score long"


def rotation(blocks: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors, those of the largest singular values first."""

    def gram(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                x = matrix(row)
                sums[row["dim"]] = sums.get(row["dim"], 0) + x.T @ x
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["dim", "i", "values"])

    each = blocks.mapInArrow(gram, "dim int, i int, values array<double>").select("dim", "i", F.posexplode("values").alias("j", "v"))
    found: dict[int, np.ndarray] = {}
    for dim, i, j, v in each.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        found.setdefault(dim, np.zeros((dim, dim)))[i, j] = v
    return {dim: np.linalg.eigh(s / max(1.0, np.abs(s).max()))[1][:, ::-1] for dim, s in found.items()}


def reach(q: np.ndarray, c: np.ndarray, turn: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which pairs may have a product of ``floor`` (one for each query) or more."""
    qr, cr = q @ turn, c @ turn
    d = q.shape[1]
    q_left, c_left = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (qr, cr))
    margin = (1e-9 * q_left[:, 0] if d else np.zeros(len(q)))[:, None] * (c_left[:, 0] if d else np.zeros(len(c)))[None] + 1e-6
    rows, cols = np.arange(len(q)), np.arange(len(c))
    so_far = np.zeros((len(q), len(c)))
    alive = np.ones((len(q), len(c)), dtype=bool)
    cuts = sorted({0, d // 8, d // 4, d // 2, d})
    for a, b in zip(cuts, cuts[1:]):
        rest = q_left[rows, a][:, None] * c_left[cols, a][None]
        alive &= so_far + rest + margin >= floor[rows][:, None]
        r, k = alive.any(axis=1), alive.any(axis=0)
        rows, cols, so_far, alive, margin = rows[r], cols[k], so_far[np.ix_(r, k)], alive[np.ix_(r, k)], margin[np.ix_(r, k)]
        if not len(rows):
            break
        so_far += qr[rows, a:b] @ cr[cols, a:b].T
    out = np.zeros((len(q), len(c)), dtype=bool)
    if len(rows):
        out[np.ix_(rows, cols)] = alive & (so_far + margin >= floor[rows][:, None])
    return out


def _tile(k: int, turns, part: int):
    def run(batches):
        for b in batches:
            for q, c in zip(b["q"].to_pylist(), b["c"].to_pylist()):
                a, all_c, ids, key = matrix(q), matrix(c), ranked_ids(c["ids"]), keys(c)
                own = np.array(q["places"], dtype=np.int64)
                floor = np.array([-np.inf if x is None else x for x in q["floors"]]) if q["floors"] is not None else np.full(len(a), -np.inf)
                top = [np.zeros(0, dtype=np.int64) for _ in range(3)]  # query, candidate, score
                for i in range(0, len(all_c), part):
                    x = all_c[i : i + part]
                    may = reach(a, x, turns.value[q["dim"]], floor) & (own[:, None] != key[None, i : i + part])
                    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                    if not len(rows):
                        continue
                    may = may[np.ix_(rows, cols)]
                    scores = product(a[rows], x[cols], may)
                    if scores.shape[1] > k:  # what is under a row's own k-th can't count; equals stay
                        low = np.where(may, scores, np.iinfo(np.int64).min)
                        may &= low >= np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None]
                    y, z = np.nonzero(may)
                    top = [np.concatenate(p) for p in zip(top, (rows[y], cols[z] + i, scores[y, z]))]
                    keep = best(top[0], top[2], ids[top[1]], key[top[1]], k)
                    top = [t[keep] for t in top]
                    number = np.bincount(top[0], minlength=len(a))
                    least = np.full(len(a), np.inf)
                    np.minimum.at(least, top[0], top[2].astype(np.float64))
                    floor = np.where(number >= k, np.maximum(floor, least), floor)
                if len(top[0]):
                    query = [q["ids"][i] for i in top[0].tolist()]
                    found = [c["ids"][i] for i in top[1].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own[top[0]]), pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(key[top[1]]), pa.array(top[2])], names=["place", "query_id", "id", "key", "score"])

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, modulus: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is divisible by ``modulus``."""
    spark = vectors.sparkSession
    with scratch(spark):
        blocks = packed(usable(vectors, id_col, vec_col), block, scale)
        queries = chosen(blocks, modulus, QUERIES)
        turns = spark.sparkContext.broadcast(rotation(blocks))
        bare = queries.withColumn("floors", F.lit(None).cast("array<double>"))
        longest = save(blocks.orderBy(F.desc("longest"), "block").limit(HEAD), "longest")
        begun = save(_first(tiles(bare, longest, F.lit(True)).mapInArrow(_tile(k, turns, PART), _OUT), k).drop("rank"), "begun")
        # the score each query has to reach, in the order of its block, and how long a vector must be for any of them
        floor = begun.groupBy("place").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
        each = queries.select("block", F.posexplode("places").alias("at", "place")).join(floor, "place", "left")
        listed = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "floor"))).alias("x")).select("block", F.col("x.floor").alias("floors"))
        known = save(queries.join(listed, "block"), "known")
        least = F.aggregate("q.floors", F.lit(float("inf")), lambda a, x: F.least(a, F.coalesce(x, F.lit(float("-inf")))))
        near = (F.col("c.longest") * F.col("q.longest") * (1 + 1e-9) + 1e-6 >= least) | (least <= 0)
        rest = blocks.join(longest.select("block"), "block", "left_anti")
        later = tiles(known, rest, near).mapInArrow(_tile(k, turns, PART), _OUT)
        out = _first(begun.union(later), k)
        return save(out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "top", outlive=True)
