import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from secspark.llm.bpe import encode_all
from secspark.llm.repair import FIRST, LEAST, compress, decode_range, expand, read_documents, write_shards
from secspark.llm.units import Units

from .helpers import SCHEMA, as_set, rows, table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def samples():
    r = np.random.default_rng(1)
    yield np.zeros(0, np.uint32)
    yield np.array([7], np.uint32)
    yield np.full(1001, 5, np.uint32)
    yield np.tile(np.array([1, 2, 3, 1, 2], np.uint32), 300)
    for top in (2, 10, 1000):
        yield r.integers(0, top, 5000).astype(np.uint32)


@pytest.mark.parametrize("ids", list(samples()))
def test_round_trip(ids):
    rules, lengths, seq = compress(ids)
    assert (expand(seq, rules, lengths) == ids).all()
    for k, n in enumerate(lengths):
        assert len(expand(np.array([FIRST + k], np.uint32), rules, lengths)) == n
    r = random.Random(2)
    for _ in range(30):
        a, b = sorted((r.randint(0, len(ids)), r.randint(0, len(ids))))
        assert (decode_range(seq, rules, lengths, a, b) == ids[a:b]).all()


def pairs(seq):
    """How often each pair occurs, not overlapping itself."""
    n, last = Counter(), {}
    for i, p in enumerate(zip(seq, seq[1:])):
        if last.get(p) != i - 1 or p[0] != p[1]:
            n[p] += 1
            last[p] = i
    return n


@pytest.mark.parametrize("ids", list(samples()))
def test_fixed_point(ids):
    """No pair is left that would pay, every rule pays, and no two rules are the same."""
    rules, _, seq = compress(ids)
    assert all(k < LEAST for k in pairs(seq.tolist()).values())
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    assert all(max(r) < FIRST + k for k, r in enumerate(rules.tolist()))
    assert 4 * len(seq) + 12 * len(rules) <= 4 * len(ids)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_are_exact(path):
    r = random.Random(5)
    bits = ["don't", "'ll", "we're", "Hello", "naïve", "x1y22", "…", "!!", "日本語", "é", "a" * 30, "%%%", "tion", "́", "̣", "😀", "'s", "''", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "　", "\x85", "\x0b", "\x1c", "​", "÷", "×", "ÿ", "Ж", "“", "—", "<|endoftext|>", "١٢", "½", "12", "’s", "ª", "\x7f", "\x00", "﻿", "ẞ", "ก", "'", "-", "'re", " '", "' ", "s", "t", "İ", "Σ", "ς", "ΑΣ", "̸", "=", "K", "Å", "ſ", "ŉ", "</w>", "≠", "<"]
    encoder = Units(path, cache=500)
    for _ in range(60):
        data = ["".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(0, 40))) for _ in range(50)]
        ids, n = encoder.encode(pa.array(data))
        at = np.cumsum(n)
        for t, want, a, b in zip(data, encode_all(path, data), at - n, at):
            assert ids[a:b].tolist() == want, repr(t)
        assert len(encoder.young) + len(encoder.old) < 4000
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_repetition_shrinks():
    ids = np.tile(np.arange(16, dtype=np.uint32), 2000)
    assert len(compress(ids)[2]) < len(ids) / 8


@pytest.mark.parametrize("shard_ids,grammar_ids", [(1 << 18, 1 << 22), (500, 300)])
def test_brute_force(spark, shard_ids, grammar_ids):
    data, t = rows(n=150), Tokenizer.from_file(BYTE)
    got = read_documents(write_shards(table(spark, data).repartition(5), BYTE, 2, shard_ids=shard_ids, grammar_ids=grammar_ids))
    docs = []
    for i, x, *_ in data:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        docs.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert as_set(got, "doc_id", "n_tokens", "ids_crc32") == sorted(map(str, docs))
    out = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got.collect())
    assert [i for _, i, _ in out] == sorted(-1 if i is None else i for i, *_ in data)
    assert all(a[0] + a[2] == b[0] for a, b in zip(out, out[1:])) and out[0][0] == 0


def test_empty(spark):
    assert read_documents(write_shards(spark.createDataFrame([], SCHEMA), BYTE, 2)).count() == 0


def test_ids_that_look_like_rules_are_refused(spark):
    import numpy as np

    from secspark.llm.repair import FIRST, known

    known(np.zeros(0, dtype=np.int64))
    known(np.array([FIRST - 1]))
    for bad in ([FIRST], [-1]):
        with pytest.raises(ValueError):
            known(np.array(bad))
    with pytest.raises(ValueError):
        write_shards(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), end_id=FIRST)
