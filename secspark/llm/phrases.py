"""Phrase collocation mining by best-first branch and bound.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``; f(phrase)
counts its contiguous occurrences inside pieces, per language. A phrase of 2 to ``longest`` words that occurs ``least`` times
is a candidate; its score is the lowest, over all cuts into a first and a second part, of floor(2000000 * a / (l + r)). A
candidate whose words lie inside a longer candidate with at least ``cover`` per cent of its count is dropped.

Growth. A phrase p with count a and first word w bounds every phrase that begins with p, itself included: such a phrase
occurs at most a times, and its cut after w has l = f(w) and r no less than its own count, so its score is at most
B(p) = floor(2000000 * a / (f(w) + a)). The frontier is grown best first, in waves with a floor for each language: all
prefixes with B >= floor are grown by a word, to the right, and phrases with a score >= floor also to the left, since only
phrases of one word more decide whether they stay (a longer one that covers enough holds one of those). After a wave every
candidate with score >= floor is known, and whether it stays. Where ``top`` of them stay the language is settled, ties
included; the others are grown anew from a floor ``STEP`` times further down, until the frontier is used up.

Counting. Texts are encoded once, in stretches of some MB: the distinct words of a stretch and the text as their numbers.
A pass counts phrases inside a stretch with numpy and leaves sums over stretches to Spark. The frontier reaches the tasks
as a bit filter of fixed size (``filter_bits``), whatever its own size: what passes wrongly is counted as well and goes in
the join with the frontier, so counts are exact. Words are compared as such, never by hash.

Defined results
- null text: no words; null language: ``und``; texts without a candidate give no row;
- equal scores: larger count, then the phrase in byte order; repeated rows and ids count as often as they occur;
- very long texts are cut into stretches at a blank, and phrases across a cut belong to the stretch they begin in;
- extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, scratch, text_or_empty
from .hashing import Words, mix, rolling

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Rank, in multiples of ``top``, of the pair whose score is the first floor, and the factor of each further wave.
FIRST_RANK, STEP = 2, 4
#: Bytes of text in a stretch, and bits of the filter that the tasks get.
STRETCH, FILTER_BITS = 2 << 20, 1 << 26
_ROWS = 1 << 16  # of a batch of phrases
_PROBES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_GRAM = 0x9FB21C651E98DF25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


# ---- encoding ----------------------------------------------------------------------------------------------------------
def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the piece of each."""
    kind = _KIND[data]
    word = np.concatenate(([False], kind == 0, [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    return starts, ends, np.searchsorted(np.flatnonzero(kind == 2), starts)


def _stretches(data: np.ndarray, size: int, ahead: int) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of about ``size`` bytes, cut between words, each followed by up to ``ahead`` words of its last piece; and its own length."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n and _KIND[data[end]] == 0:  # a word that is longer goes on
            blank = np.flatnonzero(_KIND[data[end : end + size]])
            end = end + int(blank[0]) if len(blank) else min(end + size, n)
        stop = end
        width = 1 << 12
        while stop < n:
            more = data[end : end + width]
            starts, ends, piece = _spans(more)
            cut = np.flatnonzero(_KIND[more] == 2)
            if len(cut) or len(starts) > ahead or end + width >= n:
                own = ends[piece == 0][:ahead]
                stop = end + (int(own[-1]) if len(own) else 0)
                break
            width *= 4
        yield data[at:stop], end - at
        at = end


def _encode(size: int, ahead: int):
    def rows(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
        for part, own in _stretches(data, size, ahead):
            starts, ends, piece = _spans(part)
            if not len(starts):
                continue
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part[_KIND[part] == 0]))])
            found = words.dictionary_encode()
            cuts = np.flatnonzero(np.diff(piece)) + 1  # -1 stands between pieces
            ids = np.insert(found.indices.to_numpy(), cuts, -1).astype("<i4")
            mine = int(np.searchsorted(starts, own))
            mine += int(np.searchsorted(cuts, mine))
            lists = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary.cast(pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), lists, pa.array([ids.tobytes()], pa.binary()), pa.array([mine], pa.int64())], names=["lang", "words", "ids", "own"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary())):
                held.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= size:
                    yield from rows(lang, held.pop(lang))
                    sizes.pop(lang)
                elif sum(sizes.values()) >= 8 * size if len(sizes) > 8 else False:
                    for k in list(held):
                        yield from rows(k, held.pop(k))
                    sizes.clear()
        for k in list(held):
            yield from rows(k, held.pop(k))

    return run


# ---- filters -----------------------------------------------------------------------------------------------------------
def _key(h: np.ndarray, lang: str) -> np.ndarray:
    seed = int(Words(pa.array([f"lang:{lang}".replace(" ", "_")])).hashes[0])
    return mix(h ^ np.uint64(seed))


def _probes(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for m in _PROBES:
        yield mix(key * np.uint64(m)) & np.uint64(bits - 1)


def _passes(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), dtype=bool)
    for p in _probes(key, len(bitmap) * 8):
        out &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    return mix(rolling(h, n, _GRAM)) if n > 1 else h


def bit_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits in which all rows (lang, phrase) of any number of words are set; its bytes are gathered, never its rows."""

    def run(batches):
        for b in batches:
            w = Words(b["phrase"])
            langs = b["lang"].dictionary_encode()
            number, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            found = []
            for n in np.unique(w.counts):
                at = np.flatnonzero(w.counts == n)
                h = _gram_hash(w.hashes, int(n))[w.offsets[at]]
                for k, name in enumerate(names):
                    found += list(_probes(_key(h[number[at] == k], name), bits))
            bit = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            word, first = np.unique(bit >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    set_ = phrases.select("lang", "phrase").mapInArrow(run, "word long, value long").groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[set_["word"].to_numpy()] = set_["value"].to_numpy()
    return out.view(np.uint8)


# ---- counting ----------------------------------------------------------------------------------------------------------
def _count(n: int, words=None, prefixes=None, suffixes=None, wholes=None):
    """Phrases of ``n`` words of each stretch, as strings with their count. Each filter is a broadcast bitmap or None; a phrase
    is counted if all its words are in ``words`` and its prefix, its suffix or itself is in one of the others, where given."""

    def run(batches):
        for b in batches:
            for lang, names, ids, own in zip(b["lang"].to_pylist(), b["words"], b["ids"], b["own"].to_pylist()):
                names, ids = names.values, np.frombuffer(ids.as_buffer(), dtype="<i4")
                hashes = Words(names).hashes
                some = np.append(hashes, np.uint64(0))[ids]  # a break takes the last
                fit = ids >= 0
                if words is not None:
                    fit &= np.append(_passes(words.value, _key(hashes, lang)), False)[ids]
                m = min(own, len(ids) - n + 1)
                if m <= 0:
                    continue
                keep = fit[:m].copy()
                for j in range(1, n):
                    keep &= fit[j : j + m]
                at = np.flatnonzero(keep)
                tests = [(f, k, shift) for f, k, shift in ((prefixes, n - 1, 0), (suffixes, n - 1, 1), (wholes, n, 0)) if f is not None]
                if tests and len(at):
                    good = np.zeros(len(at), dtype=bool)
                    for f, k, shift in tests:
                        good |= _passes(f.value, _key(_gram_hash(some, k)[at + shift], lang))
                    at = at[good]
                if not len(at):
                    continue
                code = ids[at].astype(np.int64)
                for j in range(1, n):
                    if j > 1:  # numbers of the phrases so far, so that the next product stays small
                        code = pa.array(code).dictionary_encode().indices.to_numpy().astype(np.int64)
                    code = code * len(names) + ids[at + j]
                _, first, count = np.unique(code, return_index=True, return_counts=True)
                first = at[first]
                for i in range(0, len(first), _ROWS):
                    some, number = first[i : i + _ROWS], count[i : i + _ROWS]
                    phrase = names.take(pa.array(ids[some]))
                    for j in range(1, n):
                        phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(ids[some + j])), " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), phrase, pa.array(number)], names=["lang", "phrase", "f"])

    return run


def _counts(coded: DataFrame, n: int, **filters) -> DataFrame:
    """lang, phrase, f: exact counts of the phrases of ``n`` words that pass the filters."""
    sc = coded.sparkSession.sparkContext
    sent = {k: sc.broadcast(v) for k, v in filters.items() if v is not None}
    return coded.mapInArrow(_count(n, **sent), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _share(a: str, *parts: str) -> Column:
    """floor(2000000 * a / sum of parts), exact beyond 64 bits."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    total = whole(parts[0])
    for p in parts[1:]:
        total = total + whole(p)
    return F.call_function("div", whole(a) * F.lit(2_000_000).cast("decimal(7,0)"), total)


def _look_up(df: DataFrame, name: str, first: int, last: int, counts: DataFrame, how: str = "inner") -> DataFrame:
    """Adds the count of a part of the phrase as column ``name``."""
    key = f"{name}_part"
    found = counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    return df.withColumn(key, _part(first, last)).join(found, ["lang", key], how).drop(key)


def _best_cut(n: int, cuts: range) -> Column:
    """The lowest-scoring cut as (score, k, l, r); ties to the smallest k."""
    return F.array_min(F.array(*[F.struct(_share("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in cuts]))


def _floors(pairs: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """lang, floor: the score of each open language's pair of this rank, or -1 where it has fewer."""
    best = pairs.join(open_, "lang", "left_semi").select("lang", "score", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))).alias("at"))
    last = best.where(F.col("at") <= rank).groupBy("lang").agg(F.min("score").alias("score"), F.max("at").alias("at"))
    return last.select("lang", F.when(F.col("at") == rank, F.col("score")).otherwise(-1).alias("floor"))


class _Growth:
    """The counts that waves share, and one wave over them."""

    def __init__(self, coded: DataFrame, words: DataFrame, pairs: DataFrame, least: int, longest: int, cover: int, bits: int):
        self.coded, self.words, self.pairs, self.least, self.longest, self.cover, self.bits = coded, words, pairs, least, longest, cover, bits
        self.word_filter = bit_filter(words, bits)

    def count(self, n: int, **filters: DataFrame) -> DataFrame:
        made = {k: bit_filter(v, self.bits) for k, v in filters.items()}
        return _counts(self.coded, n, words=self.word_filter, **made).where(F.col("f") >= self.least)

    def stay(self, candidates: DataFrame, longer: DataFrame, n: int) -> DataFrame:
        """Candidates of n words that no phrase of n + 1 words covers."""
        inside = longer.select("lang", "f", F.explode(F.array(_part(1, n), _part(2, n + 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("over"))
        covered = F.col("over").cast("decimal(19,0)") * 100 >= F.col("f").cast("decimal(19,0)") * self.cover
        return candidates.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("over")

    def score(self, grown: DataFrame, n: int, known: dict[int, DataFrame]) -> DataFrame:
        """Grown phrases of n words (with l1, bound, floor) that reach the floor, with score, l, r."""
        for k in range(2, n):
            grown = _look_up(grown, f"l{k}", 1, k, known[k])
            grown = _look_up(grown, f"r{k}", k + 1, n, known[n - k])
        if n > 2:
            grown = save(grown.where(_best_cut(n, range(2, n))["score"] >= F.col("floor")), "partly")
        rest = grown.select("lang", _part(2, n).alias("phrase")).distinct()
        missing = save(rest.join(known[n - 1], ["lang", "phrase"], "left_anti"), "missing") if n > 3 else None
        if missing is not None and missing.take(1):  # parts whose own prefix was not worth growing
            more = self.count(n - 1, wholes=missing).join(missing, ["lang", "phrase"], "left_semi")
            known = known | {n - 1: save(known[n - 1].select("lang", "phrase", "f").union(more), "known")}
        whole = _look_up(grown, "r1", 2, n, known[n - 1]).withColumn("cut", _best_cut(n, range(1, n)))
        return whole.where(F.col("cut.score") >= F.col("floor")).select("lang", "phrase", "f", "floor", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    def wave(self, floors: DataFrame) -> DataFrame:
        """All phrases whose score reaches the floor of their language and that stay."""
        here = self.pairs.join(floors, "lang")
        front = save(here.where(F.col("bound") >= F.col("floor")), "front")
        candidates = front.where(F.col("score") >= F.col("floor")).select("lang", "phrase", "f", "floor", "l", "r", "score")
        known, kept = {1: self.words, 2: self.pairs}, []
        for n in range(3, self.longest + 1):
            longer = save(self.count(n, prefixes=front, suffixes=candidates), "longer")
            kept.append(save(self.stay(candidates, longer, n - 1), "kept"))
            known[n] = longer
            grown = longer.withColumn("prefix", _part(1, n - 1)).join(front.select("lang", F.col("phrase").alias("prefix"), "floor", "l1"), ["lang", "prefix"]).drop("prefix")
            front = save(grown.withColumn("bound", _share("f", "l1", "f")).where(F.col("bound") >= F.col("floor")), "front")
            candidates = save(self.score(front, n, known), "candidates")
        kept.append(candidates)
        out = kept[0]
        for k in kept[1:]:
            out = out.unionByName(k)
        return out


def mine_phrases(
    docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, text_col: str = "text", lang_col: str = "lang",
    stretch: int = STRETCH, filter_bits: int = FILTER_BITS, first_rank: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    with scratch(docs.sparkSession):
        texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
        coded = save(texts.mapInArrow(_encode(stretch, longest - 1), "lang string, words array<string>, ids binary, own long"), "coded")
        every = save(_counts(coded, 1), "every")
        totals = save(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        words = save(every.where(F.col("f") >= least), "words")
        drop(every)
        found = _counts(coded, 2, words=bit_filter(words, filter_bits)).where(F.col("f") >= least)
        both = _look_up(_look_up(found, "l1", 1, 1, words), "r1", 2, 2, words)
        pairs = save(both.select("lang", "phrase", "f", "l1", F.col("l1").alias("l"), F.col("r1").alias("r"), _share("f", "l1", "r1").alias("score"), _share("f", "l1", "f").alias("bound")), "pairs")
        growth = _Growth(coded, words, pairs, least, longest, cover, filter_bits)
        open_, settled, rank = save(pairs.select("lang").distinct(), "open"), [], first_rank or FIRST_RANK * top
        while not settled or open_.take(1):
            floors = save(_floors(pairs, open_, rank), "floors")
            reached = save(growth.wave(floors), "reached")
            enough = reached.groupBy("lang").agg(F.count("*").alias("found"))
            done = save(floors.join(enough, "lang", "left").where((F.col("floor") < 0) | (F.col("found") >= top)).select("lang"), "done")
            settled.append(reached.join(done, "lang", "left_semi"))
            open_, rank = save(open_.join(done, "lang", "left_anti"), "open"), rank * STEP
        out = settled[0]
        for s in settled[1:]:
            out = out.unionByName(s)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
        out = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).join(totals, "lang")
        return save(out.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score"), "phrases", outlive=True)
