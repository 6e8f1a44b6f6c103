"""Hard negatives by Strassen products of integer tiles.

Anchors and candidates are packed into blocks of one label (:mod:`secspark.llm.vectors`), so a tile is all of equal or all of
different labels. A tile's scores are one Strassen product of int64 matrices, padded with zeros to sides that halve down to
``LEAF``; sums and differences are exact. Each tile leaves heaps: the best positives of each anchor, or for each window (anchor and positive) the best negatives
inside it. Heaps of several tiles merge by rank, first among the tile's own rows and then across tiles.

Defined results
- rows with a null label, or a vector that is null or holds a null or non-finite component, take no part; vectors of other dimensions don't meet;
- an anchor's own row is not its positive; another row with its id and label is; each row of an anchor's id is an anchor of its own;
- an anchor without another row of its label gives no row; neither does a positive without a negative in its window
  (so every one with a negative score), and an anchor's repeated positives each have their window;
- ties go to the smaller id (a null id last), then to the row that comes first in the blocks;
- an inner product beyond 64 bits raises OverflowError; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch
from .vectors import BLOCK, SCALE, best, chosen, fitting, keys, matrix, packed, ranked_ids, tiles, usable

#: Rows of an anchor block, and the side under which matrices are multiplied as they are.
ANCHORS, LEAF = 512, 32
_POSITIVE = "anchor_block long, at int, place long, anchor_id long, id long, key long, score long"
_NEGATIVE = "place long, anchor_id long, positive_key long, positive_id long, positive_score long, id long, key long, score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Matrix product of whole numbers (int64, or Python's integers) by seven products of halves."""
    m, d, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, d, n) <= leaf:
        if a.dtype == np.int64 and d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)  # doubles hold every sum exactly
        return a @ b
    odd = [x % 2 for x in (m, d, n)]
    if any(odd):
        a, b = np.pad(a, ((0, odd[0]), (0, odd[1]))), np.pad(b, ((0, odd[1]), (0, odd[2])))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), dtype=a.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(anchors: np.ndarray, candidates: np.ndarray, counts: np.ndarray | bool = True, leaf: int = LEAF) -> np.ndarray:
    """Exact inner products of those that count. Sums wrap around without harm as long as the products themselves fit 64 bits."""
    if anchors.shape[1] * np.abs(anchors).max(initial=0) * np.abs(candidates).max(initial=0) < 1 << 62:
        return strassen(anchors.astype(np.int64), np.ascontiguousarray(candidates.T.astype(np.int64)), leaf)
    whole = np.frompyfunc(int, 1, 1)
    return fitting(strassen(whole(anchors), whole(candidates).T, leaf), counts)


_LOW = np.iinfo(np.int64).min


def heap(score: np.ndarray, fit: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best ``k`` fitting scores of each row."""
    if score.shape[1] > k:
        low = np.where(fit, score, _LOW)
        fit = fit & (low >= np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None])
    r, c = np.nonzero(fit)
    at = best(r, score[r, c], ids[c], key[c], k)
    return r[at], c[at]


def _positives(k: int):
    def run(batches):
        for b in batches:
            for q, c in zip(b["q"].to_pylist(), b["c"].to_pylist()):
                own, key = np.array(q["places"], dtype=np.int64), keys(c)
                other = own[:, None] != key[None]
                s = scores(matrix(q), matrix(c), other)
                r, z = heap(s, other, ranked_ids(c["ids"]), key, k)
                cells = [[q["block"]] * len(r), r.tolist(), own[r].tolist(), [q["ids"][i] for i in r.tolist()], [c["ids"][i] for i in z.tolist()], key[z].tolist(), s[r, z].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(cells)], names=["anchor_block", "at", "place", "anchor_id", "id", "key", "score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches):
        for b in batches:
            for q, c in zip(b["q"].to_pylist(), b["c"].to_pylist()):
                s, ids, key = scores(matrix(q), matrix(c)), ranked_ids(c["ids"]), keys(c)
                windows = sorted(q["windows"], key=lambda w: (w["at"], w["rank"]))
                for rank in sorted({w["rank"] for w in windows}):
                    own = [w for w in windows if w["rank"] == rank]
                    rows = np.array([w["at"] for w in own], dtype=np.int64)
                    # low * p <= 100 * s <= high * p in whole numbers of s, by Python's integers
                    least = np.array([max(-(-low * w["score"] // 100), _LOW) for w in own], dtype=np.int64)
                    most = np.array([min(high * w["score"] // 100, -(_LOW + 1)) for w in own], dtype=np.int64)
                    mine = s[rows]
                    r, z = heap(mine, (mine >= least[:, None]) & (mine <= most[:, None]), ids, key, k)
                    if not len(r):
                        continue
                    r_, z_ = r.tolist(), z.tolist()
                    cells = [[q["places"][own[i]["at"]] for i in r_], [q["ids"][own[i]["at"]] for i in r_], [own[i]["key"] for i in r_], [own[i]["id"] for i in r_], [own[i]["score"] for i in r_], [c["ids"][i] for i in z_], key[z].tolist(), mine[r, z].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], names=["place", "anchor_id", "positive_key", "positive_id", "positive_score", "id", "key", "score"])

    return run


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, modulus: int, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, scale: float = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``modulus``; a negative's score lies between ``low`` and ``high`` per cent of the positive's.
    """
    with scratch(vectors.sparkSession):
        blocks = packed(usable(vectors, id_col, vec_col, label), block, scale)
        anchors = chosen(blocks, modulus, ANCHORS)
        same = F.col("q.part") == F.col("c.part")
        found = tiles(anchors, blocks, same).mapInArrow(_positives(positives), _POSITIVE)
        near = save(_first(found, ["place"], positives), "positives")
        windows = near.groupBy(F.col("anchor_block").alias("block")).agg(F.collect_list(F.struct("at", "rank", "id", "key", "score")).alias("windows"))
        armed = save(anchors.join(windows, "block"), "armed")
        made = tiles(armed, blocks, ~same).mapInArrow(_negatives(negatives, low, high), _NEGATIVE)
        out = _first(made, ["place", "positive_key"], negatives)
        names = ["anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        return save(out.select(*names), "negatives", outlive=True)
