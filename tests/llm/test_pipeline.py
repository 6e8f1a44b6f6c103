import hashlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from secspark.llm.langid import classify, train
from secspark.llm.minhash import keep_representatives

from .helpers import rows, table
from .test_minhash import near_copies, shingles

from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    """Each stage on its own input against a brute-force version."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, out = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, sf).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        frames.append(out)
    assert all(f.columns == docs.columns for f in frames[:-1])
    start, lang, exact, near, mixed, tokens = (f.collect() for f in frames)
    score = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in classify(docs, train(docs), [F.col("doc_id")]).collect()}
    assert {r["doc_id"] for r in lang} == {i for i, (p, s) in score.items() if p != "und" and s >= corpus_pipeline.MIN_MARGIN}
    first = defaultdict(list)
    for r in lang:
        first[r["text"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(min(v) for v in first.values())
    assert {r["doc_id"] for r in near} == _representatives({r["doc_id"]: shingles(r["text"], 5) for r in exact})
    assert sorted(map(str, mixed)) == sorted(map(str, near))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in tokens) == sorted((r["doc_id"], hashlib.sha256(" ".join(map(str, t.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest()) for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, tokens))


def test_positions(spark, tmp_path):
    """The result of run() has each document's place in a brute-force schedule of those that stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    docs.write.parquet(f"file://{tmp_path}/near")
    by_source = defaultdict(list)
    for r in spark.read.parquet(f"file://{tmp_path}/near").collect():
        by_source[r["source"] or ""].append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], len((r["text"] or "").encode()) + 1))
    root = {s: sum(x[2] for x in v) ** 0.5 for s, v in by_source.items()}
    rate = {s: round(x / sum(root.values()) * 2**31) for s, x in root.items()}
    total, had, blocks = sum(rate.values()), dict.fromkeys(rate, 0), defaultdict(list)
    for s, v in by_source.items():
        before = 0
        for _, i, size in sorted(v):
            blocks[s, before // 16_384].append(i)
            before += size
    want = []
    while sum(map(len, by_source.values())) > len(want):
        t = sum(had.values())
        _, s = min((-(-(had[s] + 1) * total // r), s) for s, r in rate.items() if had[s] * total // r <= t)
        want += blocks[s, had[s]]
        had[s] += 1
    assert [r["doc_id"] for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["position"])] == want


def _representatives(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def test_repeated_and_null_ids(spark):
    data = rows(n=80) + near_copies(3, 2, 10)
    docs = table(spark, data)
    out = keep_representatives(docs, 2).collect()
    sets = [frozenset(shingles(r["text"], 2)) for r in out]
    held = [s for s in sets if s]
    assert len(set(held)) == len(held)
    assert all(100 * len(a & b) < 80 * len(a | b) for n, a in enumerate(held) for b in held[:n])
    assert sum(not s for s in sets) == sum(not shingles(t, 2) for _, t, *_ in data)


def test_tokens_follow_the_order_that_mixing_has_written(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartitionByRange(5, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"file://{tmp_path}/in")
    got = corpus_pipeline.tokens_stage(spark, spark.read.parquet(f"file://{tmp_path}/in"), "").collect()
    assert sorted(r["position"] for r in got) == list(range(docs.count()))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == sorted((r["doc_id"] for r in docs.collect()), reverse=True)
