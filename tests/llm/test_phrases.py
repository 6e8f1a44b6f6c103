import random
import re
from collections import Counter

import numpy as np
import pytest

from secspark.llm.phrases import _encode, _passes, bit_filter, mine_phrases

from .helpers import rows, table


def brute(data, top, least, longest, cover):
    f, total = {}, Counter()
    for _, text, lang, *_ in data:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, c in f.items():
        found = [p for p, a in c.items() if len(p) > 1 and a >= least]
        inside = {}
        for y in found:
            for n in range(2, len(y)):
                for i in range(len(y) - n + 1):
                    inside[y[i : i + n]] = max(inside.get(y[i : i + n], 0), c[y])
        scored = []
        for p in found:
            if 100 * inside.get(p, 0) >= cover * c[p]:
                continue
            s, k = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, b.decode(), -a, left, right, total[lang], -s) for i, (s, a, b, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def text(r, words, n):
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for _ in range(n))


def data(seed, n=60):
    r = random.Random(seed)
    words = ["The", "the", "of", "a", "x", "é", "Ö", "z\x1cq", "naïve", "a-b"] + [f"w{i}" for i in range(12)]
    weights = [r.random() ** 3 for _ in words]
    texts = ["".join(r.choices(words, weights)[0] + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(r.randint(0, 80))) for _ in range(n)]
    texts += [texts[0]] * 9 + ["", None, " ..,, ", "one", "the of a x é " * 40, "q" * 3000 + " the of a"]
    return [(i, t, r.choice(["en", "en", "fr", None, ""]), "s", 0, 1, "s", "k") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, top, least, longest, rank, stretch", [(1, 1000, 2, 4, None, 1 << 20), (3, 5, 2, 5, 1, 150), (5, 12, 2, 3, 4, 64)])
def test_matches_brute_force(spark, seed, top, least, longest, rank, stretch):
    d = data(seed)
    got = mine_phrases(table(spark, d).repartition(3), top=top, least=least, longest=longest, stretch=stretch, filter_bits=1 << 12, first_rank=rank)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(d, top, least, longest, 80)


def test_a_saturated_filter_changes_nothing(spark):
    d = data(9)
    got = mine_phrases(table(spark, d), top=10, least=2, filter_bits=64, first_rank=3)
    assert sorted(map(tuple, got.collect())) == brute(d, 10, 2, 4, 80)


def test_awkward_rows(spark):
    d = rows()
    got = mine_phrases(table(spark, d), top=20, least=3)
    assert sorted(map(tuple, got.collect())) == brute(d, 20, 3, 4, 80)
    assert mine_phrases(table(spark, []), least=2).count() == 0
    assert mine_phrases(table(spark, [(1, None, None, None, 0, 1, "s", "k")]), least=2).count() == 0


def test_clashing_columns(spark):
    d = data(3, 20)
    df = table(spark, d).toDF("phrase", "text", "lang", "f", "l", "r", "rank", "score")
    assert sorted(map(tuple, mine_phrases(df, top=9, least=2).collect())) == brute(d, 9, 2, 4, 80)


def test_stretches_of_a_long_text_hold_each_phrase_once():
    import pyarrow as pa

    words = [f"w{i % 7}" for i in range(5000)] + ["y" * 700] + [f"v{i % 5}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words)])], names=["lang", "text"])
    for size in (100, 333, 1 << 20):
        got = Counter()
        for b in _encode(size, 3)([batch]):
            names, ids, own = b["words"][0].as_py(), np.frombuffer(b["ids"][0].as_py(), "<i4"), b["own"][0].as_py()
            assert len(ids) - own <= 3
            for n in (1, 4):
                got.update(tuple(names[j] for j in ids[i : i + n]) for i in range(min(own, len(ids) - n + 1)))
        want = Counter(tuple(words[i : i + n]) for n in (1, 4) for i in range(len(words) - n + 1))
        assert got == want


def test_filter_has_all_rows(spark):
    from secspark.llm.phrases import _gram_hash, _key
    from secspark.llm.hashing import Words
    import pyarrow as pa

    df = spark.createDataFrame([("en", f"a{i} b c"[: 3 + i % 4].strip()) for i in range(50)], "lang string, phrase string")
    bits = bit_filter(df, 1 << 14)
    for lang, phrase in df.collect():
        w = Words(pa.array([phrase]))
        assert _passes(bits, _key(_gram_hash(w.hashes, int(w.counts[0])), lang)).all()
        assert not _passes(bits, _key(_gram_hash(w.hashes, int(w.counts[0])), "fr")).any()


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from secspark.llm.phrases import _share

    big = (1 << 62) - 7
    got = spark.createDataFrame([(big, big - 5, big)], "f long, l long, r long").select(_share("f", "l", "r").alias("s"), F.lit(1)).first()["s"]
    assert got == 2_000_000 * big // (2 * big - 5)
