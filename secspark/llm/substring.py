"""Substring dedup by De Bruijn compaction.

Windows of ``k`` consecutive words are the edges of a De Bruijn graph. Only edges that occur twice
can matter, so the work is narrowed first: every window has an anchor (its smallest hash of ``m``
words), equal windows have equal anchors, and only windows whose anchor is repeated go on. Repeated
edges are then counted by Spark with their left and right continuations; runs of edges whose inner
nodes do not branch are compacted into paths; each path outside its source document is matched to
the path at the source (same head edge, same length, same checksum) before its words are removed.

Defined results
- null or empty text: no words, nothing removed, ``kept_sha256`` of the empty string;
- texts under ``k`` words have no window and stay whole;
- exact copies of a text are handled as one text with the smallest ``doc_id`` among them;
- rows that share a ``doc_id`` are different documents, and neither is the earlier one;
- a null ``doc_id`` comes after every other;
- extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, scratch, text_or_empty
from .hashing import Words, mix, rolling, signed, sliding

WORDS = 20
ANCHOR_WORDS = 8
_LAST = (1 << 63) - 1
_M1, _M2, _M3 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_TOP = np.uint64((1 << 64) - 1)


def _anchors(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each m-word start, smallest of each window (top value where none), and window validity."""
    short = mix(rolling(w.hashes, m, _M3)) & np.uint64((1 << 63) - 1)
    ok = w.same_text(k)
    least = sliding(short, k - m + 1, np.minimum)
    return short, np.where(ok, least, _TOP) if len(ok) else least, ok


def _slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch[column]).to_pylist()], dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0, 0]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _sketch(k: int, m: int):
    def run(batches):
        for whole in batches:
            for b in _slices(whole, "text"):
                w = Words(b["text"])
                n = b.num_rows
                short, least, ok = _anchors(w, k, m)
                # a start is an anchor if the largest minimum of the windows over it is its own hash
                span = k - m + 1
                mins = np.where(ok, least, np.uint64(0)) if len(ok) else least
                padded = np.concatenate((np.zeros(span - 1, np.uint64), mins, np.zeros(max(0, len(short) - len(mins)), np.uint64)))
                top = sliding(padded, span, np.maximum)[: len(short)]
                at = np.flatnonzero(top == short) if len(short) and len(mins) else np.zeros(0, dtype=np.int64)
                text = w.text[at]
                counts = np.bincount(text, minlength=n)[:n]
                shas = [hashlib.sha256(b" ".join(x.encode().split())).hexdigest() for x in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b["did"], b["th"], b["tl"], pa.array(w.counts.astype(np.int64)), pa.array(shas), _lists(pa.array(signed(short[at])), counts), _lists(pa.array((at - w.offsets[text]).astype(np.int32)), counts)],
                    names=["did", "th", "tl", "n_words", "full_sha", "anchor", "pos"],
                )

    return run


def _windows(k: int, m: int):
    def run(batches):
        for whole in batches:
            for b in _slices(whole, "text"):
                w = Words(b["text"])
                short, least, ok = _anchors(w, k, m)
                lists = b["pos"]
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                marked = np.full(len(short), _TOP, dtype=np.uint64)
                at = flat + np.repeat(w.offsets[:-1], sizes)
                marked[at] = short[at]
                hit = np.flatnonzero(ok & (sliding(marked, k - m + 1, np.minimum) == least)) if len(ok) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                one = mix(rolling(w.hashes, k, _M1))[hit]
                two = mix(rolling(mix(w.hashes + np.uint64(1)), k, _M2))[hit]
                text = w.text[hit]
                first, last = w.offsets[:-1][text], w.offsets[1:][text]
                n = len(w.hashes)
                prv = np.where(hit > first, w.hashes[np.maximum(hit - 1, 0)], np.uint64(0))
                nxt = np.where(hit + k < last, w.hashes[np.minimum(hit + k, n - 1)], np.uint64(0))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one)), pa.array(signed(two)), b["did"].take(take), b["th"].take(take), pa.array((hit - first).astype(np.int32)), pa.array(signed(prv)), pa.array(signed(nxt))],
                    names=["w1", "w2", "did", "th", "pos", "prv", "nxt"],
                )

    return run


def _cut(k: int):
    def run(batches):
        for whole in batches:
            for b in _slices(whole, "text"):
                w = Words(b["text"])
                one = mix(rolling(w.hashes, k, _M1))
                two = mix(rolling(mix(w.hashes + np.uint64(1)), k, _M2))
                removed, shas, n_words = [], [], []
                texts, spans = b["text"].to_pylist(), b["spans"].to_pylist()
                for i in range(b.num_rows):
                    lo, hi = int(w.offsets[i]), int(w.offsets[i + 1])
                    n = hi - lo
                    cover = np.zeros(n + 1, dtype=np.int64)
                    for s in spans[i] or ():
                        cover[s["start"]] += 1
                        cover[s["start"] + s["len"] + k - 1] -= 1
                    if n >= k:  # windows that start earlier in this text
                        a, c = one[lo : hi - k + 1], two[lo : hi - k + 1]
                        order = np.lexsort((c, a))  # stable: equal windows stay in order
                        same = (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])
                        again = order[1:][same]
                        np.add.at(cover, again, 1)
                        np.add.at(cover, again + k, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    words = texts[i].encode().split()
                    removed.append(int(gone.sum()))
                    n_words.append(n)
                    shas.append(hashlib.sha256(b" ".join(x for x, g in zip(words, gone.tolist()) if not g)).hexdigest())
                yield pa.RecordBatch.from_arrays([b["th"], b["tl"], pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["th", "tl", "cut", "cut_sha"])

    return run


def repeated_paths(texts: DataFrame, k: int = WORDS, m: int = ANCHOR_WORDS) -> DataFrame:
    """Compacted repeated paths of ``texts`` (did, th, text, pos: starts of repeated anchors).

    One row per path and text outside the path's source: did, th, start, len (in windows), src_did,
    src_start. ``len`` windows cover ``len + k - 1`` words.
    """
    windows = texts.select("did", "th", "text", "pos").mapInArrow(_windows(k, m), "w1 long, w2 long, did long, th long, pos int, prv long, nxt long")
    edges = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("did").alias("md"), F.min("prv").alias("p0"), F.max("prv").alias("p1"), F.min("nxt").alias("n0"), F.max("nxt").alias("n1"))
    edges = save(
        edges.where("n > 1").select("w1", "w2", "md", (F.col("p0") != F.col("p1")).alias("lb"), (F.col("n0") != F.col("n1")).alias("rb")),
        "edges",
    )
    seen = windows.select("w1", "w2", "did", "th", "pos").join(edges, ["w1", "w2"])
    order = Window.partitionBy("th", "did").orderBy("pos")
    broken = F.coalesce((F.col("pos") != F.lag("pos").over(order) + 1) | F.col("lb") | F.lag("rb").over(order) | (F.col("md") != F.lag("md").over(order)), F.lit(True))
    runs = seen.withColumn("path", F.sum(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paths = save(
        runs.groupBy("th", "did", "path").agg(F.min("pos").alias("start"), F.count("*").alias("len"), F.min("md").alias("src_did"), F.min_by("w1", "pos").alias("h1"), F.min_by("w2", "pos").alias("h2"), F.bit_xor("w2").alias("check")).drop("path"),
        "paths",
    )
    drop(edges)
    # written first: a join of two plain exchanges lets Spark split the rows of a passage that is everywhere
    source = save(paths.where("did = src_did").groupBy("h1", "h2", "len", "check").agg(F.min("src_did").alias("src_did"), F.min("start").alias("src_start")), "source")
    return paths.where("did > src_did").drop("src_did").join(source, ["h1", "h2", "len", "check"]).select("did", "th", "start", "len", "src_did", "src_start")


def substring_dedup(docs: DataFrame, k: int = WORDS, m: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove words covered by a ``k``-word window that also starts earlier.

    Returns doc_id, n_words, n_removed, kept_sha256 and is_copy (an earlier row has the same text).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", "did", F.xxhash64("text").alias("th"), F.hash("text").alias("tl"), "text")
    with scratch(docs.sparkSession):
        sketch = rows.select("did", "th", "tl", "text").mapInArrow(_sketch(k, m), "did long, th long, tl int, n_words long, full_sha string, anchor array<long>, pos array<int>")
        base = save(sketch.groupBy("th", "tl").agg(F.min("did").alias("did"), *[F.first(c).alias(c) for c in ("n_words", "full_sha", "anchor", "pos")]), "base")
        found = base.select("th", "tl", "did", F.explode(F.arrays_zip("anchor", "pos")).alias("x")).select("th", "tl", "did", F.col("x.anchor").alias("h"), F.col("x.pos").alias("pos"))
        repeated = save(
            found.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.min("pos").alias("c"), F.max("pos").alias("d")).where("a <> b or c <> d").select("h"),
            "repeated",
        )
        lists = save(found.join(repeated, "h").groupBy("th", "tl", "did").agg(F.collect_list("pos").alias("pos")), "lists")
        drop(repeated)
        texts = rows.select("th", "tl", "did", "text").join(lists, ["th", "tl", "did"])
        texts = save(texts.dropDuplicates(["th", "tl"]), "texts")
        drop(lists)
        spans = repeated_paths(texts, k, m).groupBy("th", "did").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
        cut = save(texts.join(save(spans, "spans"), ["th", "did"], "left").select("th", "tl", "text", "spans").mapInArrow(_cut(k), "th long, tl int, cut long, cut_sha string"), "cut")
        drop(texts)
        known = save(base.select("th", "tl", F.col("did").alias("first"), "n_words", "full_sha").join(cut, ["th", "tl"], "left"), "known", outlive=True)
    copy = (F.col("did") > F.col("first")) & (F.col("n_words") >= k)
    return (
        rows.select("doc_id", "did", "th", "tl")
        .join(known, ["th", "tl"])
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "full_sha")).alias("kept_sha256"),
            (F.col("did") > F.col("first")).alias("is_copy"),
        )
    )
