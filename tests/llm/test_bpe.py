import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from secspark.llm.bpe import encode_all, encode_tree, split, token_digests, tokens

from .helpers import SCHEMA, as_set, rows, table

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["don't we'll I'd", "a  b   c \n\n d\t\te", "x y z\x1cq", "<|endoftext|> a  <|endoftext|>b", "été ́x", "'s 't're  's", "12345 6 七八", "\n\n", " lead", "trail  ", "\r\nA\r\nB", "!!'s ??", "ÉÀ ẞ İ", "\x85a​b﻿", "ẹ́́ô" * 20, "😀👩‍👩‍👧 " * 30]


def texts(seed, n=60):
    r = random.Random(seed)
    bits = ["don't", "'ll", "we're", "Hello", "naïve", "x1y22", "…", "!!", "日本語", "é", "a" * 30, "%%%", "tion", "́", "̣", "😀", "'s", "''"]
    return ["".join(r.choice(bits) + r.choice([" ", "  ", "\n", "", "", "\t", " \n ", "", ""]) for _ in range(r.randint(0, 80))) for _ in range(n)] + ODD


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("leaf,window", [(16, 1), (7, 2), (40, 3), (100, 64), (3, 1)])
def test_joins_are_exact(path, leaf, window):
    data = [t for seed in range(4) for t in texts(seed + leaf)]
    for t, want in zip(data, encode_all(path, data)):
        assert encode_tree(path, t, leaf, window) == want, repr(t)


def test_halves():
    for t in [*texts(1), "", "á" * 50, "́" * 50]:
        pieces = split(t, 9)
        assert "".join(pieces) == t and (len(pieces) == 1 or len(pieces) & (len(pieces) - 1) == 0)


def brute(data, path):
    t = Tokenizer.from_file(path)
    out = []
    for i, x, *_ in data:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        out.append((i, len(ids), *sha))
    return sorted(map(str, out))


@pytest.mark.parametrize("path,leaf,window", [(WORD, None, None), (BYTE, None, None), (WORD, 300, 8), (BYTE, 50, 2)])
def test_brute_force(spark, path, leaf, window):
    data = rows() + [(1000 + i, t, "en", "a", 1, 1, "s", "k") for i, t in enumerate(texts(5))]
    got = token_digests(table(spark, data), path, leaf=leaf, window=window)
    assert as_set(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute(data, path)


def test_long_unsplit_text_is_shared_by_tasks(spark):
    """A megabyte without white space: its halves are rows on several partitions, and the result is the library's."""
    from secspark.llm import bpe

    r = random.Random(4)
    data = [(k, "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=1_000_000)), "en", "a", 1, 1, "s", "k") for k in range(2)]
    docs = table(spark, data)
    pieces = docs.select(F.col("doc_id").alias("row"), "text").mapInArrow(bpe._split(bpe.LEAF), "row long, n long, text string")
    assert pieces.repartition(4, "row", "n").select(F.spark_partition_id()).distinct().count() > 1 and pieces.count() == 32
    assert as_set(token_digests(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute(data, WORD)


def test_round_trip(spark):
    data = [(i, t, "en", "a", 1, 1, "s", "k") for i, t in enumerate(texts(6)) if "\x1c" not in t]
    got = {x["doc_id"]: x["decoded"] for x in tokens(table(spark, data), BYTE).collect()}
    assert all(got[i] == t for i, t, *_ in data)


def test_clashing_columns(spark):
    docs = table(spark, n=20).withColumn("row", F.lit("x")).withColumn("n", F.lit("y")).withColumn("ids", F.lit(1)).withColumn("starts", F.lit(2))
    got = token_digests(docs, WORD, leaf=100, carry=("source",))
    assert as_set(got, "doc_id", "n_tokens") == as_set(token_digests(docs.select("doc_id", "text"), WORD), "doc_id", "n_tokens")


def test_empty(spark):
    assert token_digests(spark.createDataFrame([], SCHEMA), WORD).count() == 0
