import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secspark.llm.innerproducts import reach, top_products
from secspark.llm.negatives import hard_negatives, scores, strassen
from secspark.llm.vectors import product

SCHEMA = "vec_id long, embedding array<double>, label int, score long, key string"
LAST = (1 << 63) - 1


def data(seed=1, n=300, dim=6, copies=60):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 1) * (3 if i % 9 == 0 else 1) for _ in range(dim)], r.choice([1, 1, 1, 2, 3, None])) for i in range(n)]
    same = out[4][1]
    out += [(n + i, list(same), r.choice([1, 2])) for i in range(copies)]  # one vector's copies, ties everywhere
    out += [(None, list(same), 1), (None, out[7][1], 2), (1001, None, 1), (1100, [0.1] * (dim - 1) + [None], 1), (1102, [math.nan] * dim, 2), (1103, [math.inf] * dim, 2)]
    out += [(1200, [0.0] * dim, 1), (1201, [], 1), (1300, [1.0] * (dim + 1), 2), (1301, [0.5] * (dim + 1), 2), (1302, [0.6] * (dim + 1), 3), (-100, out[3][1], 3)]
    r.shuffle(out)
    return [(*x, 9, "k") for x in out]


def usable(d):
    return [(i, [math.floor(256 * x) for x in v], None if y is None else y) for i, v, y, *_ in d if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(d, modulus, k):
    rows, out = usable(d), []
    for n, (q, v, _) in enumerate(rows):
        if q is not None and q % modulus == 0:
            found = sorted((-dot(v, w), LAST if c is None else c) for m, (c, w, _) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out += [(q, i + 1, None if c == LAST else c, -s) for i, (s, c) in enumerate(found)]
    return sorted(map(str, out))


def brute_negatives(d, modulus, k):
    rows, out = [x for x in usable(d) if x[2] is not None], []
    for n, (a, v, y) in enumerate(rows):
        if a is not None and a % modulus == 0:
            others = [(-dot(v, w), LAST if c is None else c, z) for m, (c, w, z) in enumerate(rows) if m != n and len(w) == len(v)]
            for p, pid, _ in sorted(x for x in others if x[2] == y)[:k]:
                fits = sorted(x for x in others if x[2] != y and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
                out += [(a, None if pid == LAST else pid, i + 1, None if c == LAST else c, -p, -s) for i, (s, c, _) in enumerate(fits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed, block, k", [(1, 32, 5), (2, 7, 2), (3, 2048, 40)])
def test_top_products(spark, seed, block, k):
    d = data(seed)
    got = top_products(spark.createDataFrame(d, SCHEMA).repartition(3), 25, k, block=block)
    assert sorted(map(str, map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))) == brute_top(d, 25, k)


@pytest.mark.parametrize("seed, block", [(1, 32), (2, 7), (3, 2048)])
def test_hard_negatives(spark, seed, block):
    d = data(seed)
    got = hard_negatives(spark.createDataFrame(d, SCHEMA).repartition(3), 20, F.col("label"), block=block)
    assert sorted(map(str, map(tuple, got.collect()))) == brute_negatives(d, 20, 5)


def test_repeated_rows_and_ids(spark):
    d = [(50, [1.0, 0.0], 1, 0, ""), (50, [1.0, 0.0], 1, 0, ""), (50, [0.0, 1.0], 2, 0, ""), (3, [0.9, 0.0], 2, 0, "")]
    df = spark.createDataFrame(d, SCHEMA)
    assert sorted(map(str, map(tuple, top_products(df, 50, 5).collect()))) == brute_top(d, 50, 5)
    assert sorted(map(str, map(tuple, hard_negatives(df, 50, F.col("label")).collect()))) == brute_negatives(d, 50, 5)


def test_empty_tables(spark):
    for d in ([], [(50, None, 1, 0, ""), (100, [math.nan], 1, 0, "")], [(100, [1.0], 1, 0, "")], [(7, [1.0], 1, 0, "")] * 2):
        df = spark.createDataFrame(d, SCHEMA)
        assert top_products(df, 50, 5).count() == 0 and hard_negatives(df, 100, F.col("label")).count() == 0


def test_large_components(spark):
    d = [(50, [2.0**26, 1.0], 1, 0, ""), (1, [2.0**20, 3.0], 1, 0, ""), (2, [2.0**20, 3.25], 2, 0, ""), (3, [2.0**20 - 1, 3.0], 2, 0, "")]
    df = spark.createDataFrame(d, SCHEMA)
    assert sorted(map(str, map(tuple, top_products(df, 50, 5).collect()))) == brute_top(d, 50, 5)
    assert sorted(map(str, map(tuple, hard_negatives(df, 50, F.col("label")).collect()))) == brute_negatives(d, 50, 5)
    with pytest.raises(Exception, match="passes 64 bits"):
        top_products(spark.createDataFrame([(50, [2.0**60], 1, 0, ""), (1, [2.0**60], 1, 0, "")], SCHEMA), 50, 5).count()


@pytest.mark.parametrize("m, d, n, leaf", [(5, 7, 9, 1), (64, 64, 64, 8), (33, 65, 130, 4), (1, 64, 3, 2), (40, 3, 40, 2), (17, 0, 3, 2)])
def test_strassen(m, d, n, leaf):
    r = np.random.default_rng(m)
    a, b = r.integers(-300, 300, (m, d)), r.integers(-300, 300, (d, n))
    assert (strassen(a, b, leaf) == a @ b).all()
    big = r.integers(-(1 << 28), 1 << 28, (m, d)).astype(np.float64)
    other = r.integers(-(1 << 28), 1 << 28, (n, d)).astype(np.float64)
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in other] for p in big]
    assert scores(big, other, leaf=leaf).tolist() == want and product(big, other).tolist() == want


def test_no_pair_over_the_floor_is_given_up():
    r = np.random.default_rng(0)
    for dim in (1, 3, 8, 64):
        q, c = np.floor(r.normal(0, 40, (20, dim))), np.floor(r.normal(0, 40, (50, dim)) * r.uniform(0.1, 2, (50, 1)))
        turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        exact = q @ c.T
        floor = np.partition(exact, -3, axis=1)[:, -3]
        may = reach(q, c, turn, floor)
        assert may[exact >= floor[:, None]].all()
        assert dim < 8 or may.sum() < may.size  # and some are


def test_plan_has_no_nested_loop(spark):
    from secspark.llm.vectors import packed, tiles, usable

    df = spark.createDataFrame(data(), SCHEMA)
    blocks = packed(usable(df, "vec_id", "embedding"), 16)
    plan = tiles(blocks, blocks, F.col("c.longest") > 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
