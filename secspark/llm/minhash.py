"""MinHash near-dedup: many universal-hash minima, banding, verification, connected components.

Each document's set of word shingles gets ``BANDS * ROWS`` minima of universal hashes. Documents that
agree on all rows of a band share a bucket. In a bucket every member is compared with ``HUBS`` hubs
(the members with the most bucket neighbours over all bands), confirmed on full shingle sets, and
linked. Where a bucket's members are then still in different components, those outside its main
component are compared with all members of other components whose signatures agree well enough; each
pair once, at the first band they share. So a pair of a bucket stays unconfirmed only if both are
connected already or their signatures rule the similarity out. Components are found with alternating
large-star and small-star steps. Documents with equal sets are one node throughout.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^50 = 2.6e-7. Signatures are compared
in four bits of each minimum; a pair goes on if the agreement is at most 5.2 standard deviations below what
the similarity asks for, which a true pair misses with probability 1e-7. Before that a bitmap of each set,
a bit for each hash range that is hit, bounds the symmetric difference: bits that differ are at most as
many as elements that differ, so this test never loses a pair.

Defined results
- null text, empty text and text without words: an empty set, linked with nothing;
- fewer words than the shingle size: the whole sequence is the one shingle;
- component_id is the smallest doc_id reachable; null ids never name a component unless all its ids are
  null; rows that share a doc_id are separate documents;
- extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, scratch, text_or_empty
from .hashing import Words, mix, rolling, signed
from .substring import _lists, _slices

BANDS, ROWS = 50, 6
HUBS = 3
PLANES = 4
DEVIATIONS = 5.2
BITMAP = 2048
_MULT = 0xE7037ED1A0B428DB


def shingle_sets(w: Words, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their counts."""
    full = mix(rolling(w.hashes, size, _MULT))
    ok = np.flatnonzero(w.same_text(size))
    text, value = w.text[ok], full[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = []
        for i in short:
            h = hashlib.blake2b(w.hashes[w.offsets[i] : w.offsets[i + 1]].tobytes(), digest_size=8, person=b"short").digest()
            extra.append(int.from_bytes(h, "little"))
        text, value = np.concatenate((text, short)), np.concatenate((value, np.array(extra, dtype=np.uint64)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
        text, value = text[new], value[new]
    return value, np.bincount(text, minlength=n)[:n]


def _universal(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        a, b = _universal(bands * rows)
        seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in batches:
            for batch in _slices(whole, "text"):
                n = batch.num_rows
                value, counts = shingle_sets(Words(batch["text"], lower=True), n, size)
                ends = np.cumsum(counts)
                digest, keys = [], np.zeros((n, bands), dtype=np.uint64)
                words = -(-bands * rows // 64)
                bits = np.zeros((n, PLANES * words + BITMAP // 64), dtype=np.uint64)
                for i in range(n):
                    s = value[ends[i] - counts[i] : ends[i]]
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if not len(s):
                        continue
                    sig = np.full(bands * rows, np.uint32(0xFFFFFFFF), dtype=np.uint32)
                    for at in range(0, len(s), 128):  # the upper half of a*x+b, in blocks that stay in cache
                        h = np.multiply.outer(a, s[at : at + 128])
                        h += b[:, None]
                        np.minimum(sig, h.view(np.uint32)[:, 1::2].min(axis=1), out=sig)
                    k = seeds.copy()
                    for r in range(rows):
                        k = mix(k ^ sig[r::rows].astype(np.uint64))
                    keys[i] = k
                    for p in range(PLANES):
                        plane = np.zeros(words * 64, dtype=np.uint8)
                        plane[: len(sig)] = (sig >> np.uint32(p)) & np.uint32(1)
                        bits[i, p * words : (p + 1) * words] = np.packbits(plane).view(np.uint64)
                    bitmap = np.zeros(BITMAP, dtype=np.uint8)
                    bitmap[(s >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int64)] = 1
                    bits[i, PLANES * words :] = np.packbits(bitmap).view(np.uint64)
                lists = _lists(pa.array(signed(keys.reshape(-1))), np.where(counts > 0, bands, 0))
                if (counts == 0).any():
                    flat = keys[counts > 0].reshape(-1)
                    lists = _lists(pa.array(signed(flat)), np.where(counts > 0, bands, 0))
                planes = _lists(pa.array(signed(bits.reshape(-1))), np.full(n, bits.shape[1]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(digest, pa.binary()), pa.array(counts.astype(np.int64)), lists, planes], names=["doc_id", "th", "node", "n_shingles", "bands", "bits"])

    return run


def _sets(size: int):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole, "text"):
                value, counts = shingle_sets(Words(batch["text"], lower=True), batch.num_rows, size)
                ends = np.cumsum(counts)
                digest = [hashlib.blake2b(value[e - c : e].tobytes(), digest_size=16).digest() for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), _lists(pa.array(signed(value)), counts)], names=["node", "items"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity."""
    u = sets.select(F.col("node").alias("u"), F.col("items").alias("_a"))
    v = sets.select(F.col("node").alias("v"), F.col("items").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return pairs.join(v, "v").join(u, "u").where(both * 100 >= percent * (F.size("_a") + F.size("_b") - both)).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (u, v); large-star and small-star in turn.

    Rounds go on until one changes nothing: links only ever move to smaller nodes, so there is such a round.
    """
    e = save(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split the join at a node with very many links
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = save(both.join(least, "u").where("v > u and m <> v").select(F.col("m").alias("u"), "v"), "large")
        best = large.groupBy("v").agg(F.min("u").alias("m"))
        made = F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.when(F.col("u") != F.col("m"), F.struct(F.col("m").alias("u"), F.col("u").alias("v"))))
        small = save(large.join(best, "v").select(F.explode(made).alias("x")).where("x is not null").select("x.u", "x.v").distinct(), "small")
        drop(large, e, least)
        e = small
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, root) after more links (u, v): components meet by their roots, so rounds go over roots only."""
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    every = save(found.select("node", "root").union(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))), "every")
    of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(of("u"), "u").join(of("v"), "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return save(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "found")


def _worth_a_look(percent: int, bands: int, rows: int) -> Column:
    """Of two members x and y of a bucket: should the pair be confirmed, here and not at an earlier band?

    The tests are in the order of their cost, and the join gives out only rows that pass.
    """
    total = bands * rows
    words = -(-total // 64)
    p = percent / 100 + (1 - percent / 100) / (1 << PLANES)
    least = math.floor(total * p - DEVIATIONS * math.sqrt(total * p * (1 - p)))
    agree = F.lit(total - words * 64)  # the unused bits are zero in both
    for w in range(words):
        differ = F.lit(0).cast("long")
        for q in range(PLANES):
            differ = differ.bitwiseOR(F.col("x.bits")[q * words + w].bitwiseXOR(F.col("y.bits")[q * words + w]))
        agree = agree + (F.lit(64) - F.bit_count(differ))
    apart = F.lit(0)
    for w in range(PLANES * words, PLANES * words + BITMAP // 64):
        apart = apart + F.bit_count(F.col("x.bits")[w].bitwiseXOR(F.col("y.bits")[w]))
    near = apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    sizes = (F.least("x.n", "y.n") * 100) >= F.greatest("x.n", "y.n") * percent
    first = F.get(F.col("x.bands"), (F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) - 1).cast("int"))
    return (F.col("x.root") != F.col("y.root")) & once & sizes & near & (agree >= least) & (first == F.col("x.key"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; and node (digest of the set), root (of its component), th (text hash)."""
    with scratch(docs.sparkSession):
        texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
        signed_ = save(texts.mapInArrow(_sign(shingle, bands, rows), "doc_id long, th long, node binary, n_shingles long, bands array<long>, bits array<long>"), "signed")
        narrow = signed_.select("doc_id", "th", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), "n_shingles")
        did = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        per_set = signed_.where("n_shingles > 0").groupBy("node")
        keys = per_set.agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key"))
        nodes = save(per_set.agg(F.min("doc_id").alias("least"), F.min(did).alias("did"), F.min_by("th", did).alias("th")), "nodes")
        shared = save(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        members = save(keys.join(shared, "key").select("key", "node", "size"), "members")
        drop(shared)
        weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node"))
        hubs = members.select("key", "node").join(weight, "node").withColumn("rank", rank).where(F.col("rank") <= HUBS).select("key", F.col("node").alias("u"))
        hubs = save(hubs, "hubs")
        star = members.join(hubs, "key").where("u <> node").select("u", F.col("node").alias("v")).distinct()
        star = save(star, "star")
        involved = members.select("node").distinct()
        # one text for each set that shares a bucket: only those are read again
        chosen = nodes.join(involved, "node").select("th", "did").distinct()
        bare = texts.withColumn("did", did).join(chosen, ["th", "did"], "left_semi").select("text")
        hashed = bare.mapInArrow(_sets(shingle), "node binary, items array<long>")
        sets = save(hashed.join(involved, "node", "left_semi").dropDuplicates(["node"]), "sets")
        links = save(confirm(star, sets, percent), "links")
        found = save(components(links), "found")
        # what is left: members outside the main component of their bucket
        labelled = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        parts = labelled.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"))
        mixed = save(parts.where("roots > 1").select("key", "main"), "mixed")
        details = per_set.agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        open_ = save(labelled.join(mixed, "key").join(details, "node"), "open")
        drop(members, hubs, mixed)
        x, y = open_.where("root <> main").alias("x"), open_.alias("y")
        cross = x.join(y, F.col("x.key") == F.col("y.key")).where(_worth_a_look(percent, bands, rows))
        cross = cross.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()
        tested = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        cross = save(cross.join(tested, ["u", "v"], "left_anti"), "cross")
        drop(open_)
        late = save(confirm(cross, sets, percent), "late")
        if late.take(1):
            found = joined(found, late)
        drop(cross, sets, star)
        least = nodes.select("node", "least")
        named = least.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        # written, so that Spark can split the join of a component with very many sets
        names = save(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
        by_node = save(named.join(names, "root").select("node", "root", "component_id"), "names")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = narrow.join(by_node, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), "node", "root", "th")
        return save(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node", "root", "th"), "near", outlive=True)


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one for each component.

    Rows are named by id and text hash. Of the rows whose id names their component, the one with the
    smallest text hash stays (a null id counts as the largest); of equal rows, one. Rows without words
    are linked with nothing and all stay.
    """
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col)
        linked = found.where(F.col("node").isNotNull())
        did = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        best = linked.groupBy("root").agg(F.min(did).alias("did"))
        best = linked.select("root", "th", did.alias("did")).join(best, ["root", "did"]).groupBy("root", "did").agg(F.min("th").alias("th"))
        stay = save(best.select("did", "th").distinct(), "stay", outlive=True)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("did"),
        F.xxhash64(text_or_empty(text_col)).alias("th"),
        text_or_empty(text_col).rlike(r"[^\x20\x09-\x0D]").alias("words"),
    )
    kept = packed.where("words").join(stay, ["did", "th"], "left_semi").dropDuplicates(["did", "th"])
    return kept.select("_row.*").union(packed.where("not words").select("_row.*"))
