import hashlib
import re

import pytest

from secspark.llm.substring import repeated_paths, substring_dedup

from .helpers import SCHEMA, as_set, rows, table


def brute(data, k):
    first = {}
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, *_ in data]
    inf = float("inf")
    for i, w in docs:
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first.setdefault(key, []).append((inf if i is None else i, p))
    out = []
    for i, w in docs:
        d = inf if i is None else i
        gone = [False] * len(w)
        own = set()
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in own or min(first[key])[0] < d:
                gone[p : p + k] = [True] * k
            own.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("k,m,vocab,seed", [(20, 8, 40, 3), (6, 3, 5, 4), (4, 2, 2, 5)])
def test_brute_force(spark, k, m, vocab, seed):
    data = rows(seed=seed, vocab=vocab)
    got = substring_dedup(table(spark, data), k, m)
    assert as_set(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, k)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_path_has_source(spark):
    p = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, 11, "a b " + p, list(range(25))), (2, 12, p + " c", list(range(23)))], "did long, th long, text string, pos array<int>")
    assert [tuple(x) for x in repeated_paths(docs).collect()] == [(2, 12, 0, 11, 1, 2)]
