import random
import re

import pytest

from secspark.llm.minhash import components, near_duplicates

from .helpers import SCHEMA, as_set, rows, table


def shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(data, size, percent):
    sets = [shingles(t, size) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, *_) in enumerate(data):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, d == c))
    return sorted(map(str, out))


def near_copies(seed, n_groups=6, copies=25):
    """Groups whose copies are close to a base but often not to each other."""
    r, out = random.Random(seed), []
    for _ in range(n_groups):
        base = [f"v{r.randint(0, 10**6)}" for _ in range(120)]
        out.append(base)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(1, 12)):
                w[r.randrange(len(w))] = f"u{r.randint(0, 10**6)}"
            out.append(w)
    r.shuffle(out)
    return [(i, " ".join(w), "en", "a", 1, 1, "s", "k") for i, w in enumerate(out)]


@pytest.mark.parametrize("data,size", [(rows(vocab=400), 2), (rows(seed=9), 5), (near_copies(1), 2), (near_copies(2), 5)])
def test_brute_force(spark, data, size):
    got = near_duplicates(table(spark, data), size)
    assert as_set(got, "doc_id", "n_shingles", "component_id", "kept") == brute(data, size, 80)


def test_components_of_a_long_chain(spark):
    r = random.Random(1)
    ids = list(range(64))
    r.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids[:40], ids[1:40])] + [(a, b) for a, b in zip(ids[40:], ids[41:])]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: min(ids[:40]) for i in ids[:40]} | {i: min(ids[40:]) for i in ids[40:]}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_more_links_join_components(spark):
    """Components found first and then joined are those of all links at once."""
    from secspark.llm.minhash import joined

    r = random.Random(8)
    first = [(bytes([r.randint(0, 60)]), bytes([r.randint(0, 60)])) for _ in range(25)]
    for n in (0, 1, 12):
        more = [(bytes([r.randint(0, 90)]), bytes([r.randint(0, 90)])) for _ in range(n)]
        frame = lambda x: spark.createDataFrame(x, "u binary, v binary")
        got = {(bytes(a), bytes(b)) for a, b in joined(components(frame(first)), frame(more)).collect()}
        want = {(bytes(a), bytes(b)) for a, b in components(frame(first + more)).collect()}
        # a link of a node with itself leaves the node a component of its own
        assert {x for x in got if x[0] != x[1] or x in want} == want and all(x[0] == x[1] for x in got - want)
