"""Mixing sources to target weights by Pfair scheduling.

Each source is a sequence of bytes, cut into blocks of ``block_bytes``. Block k of a source with weight w is
released at floor(k / w) and is due at ceil((k + 1) / w); in each slot the released block with the earliest
deadline goes first (ties: by source name). While all sources last, after t slots each source has had within
one block of w * t blocks. :func:`mix_blocks` puts out exactly these blocks: a record that crosses a block's
end is cut there, and its pieces take the slots of their blocks, so the bound holds for the bytes put out.
:func:`mix` and :func:`in_order` keep records whole, each at the slot of its first block; a source can then
be ahead by as much as the rest of its last record.

Weights are target weights: whole numbers are taken as they are, others as whole shares of about 2^31
(``rates_*``). Slots are those of one period, repeated; stretches of a long period are scheduled in parallel, without a
run over what lies before them (:func:`period`). So blocks have the given size at every volume.

When a source has run out its slots are passed over, and the rest keep their order. Every byte stays.

Defined results
- a null source is a source of its own, named like the empty string; null text counts as empty;
- size is the UTF-8 bytes of the text plus 1;
- inside a source records follow the MD5 of their id, then id, then size; equal records may trade places;
- a source without a given weight has the smallest of the given ones;
- extra columns are ignored; an empty table gives an empty result.

Rows are ordered in windows over (source, part of the MD5) and over stretches of slots, never in one task. A
stretch's row holds one entry for each source, and each slot looks at all of them: sources are meant to number thousands, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch, text_or_empty

BLOCK_BYTES = 16_384
STRETCHES = 4096
SHARES = 1 << 31
#: Slots of a stretch: as many as the longest window between these two.
STEPS, MOST_STEPS = 1024, 8192


def rates_by_root_share(sizes: DataFrame) -> DataFrame:
    """source, bytes, rate: weights in proportion to the square root of a source's bytes, as shares of about 2^31."""
    root = F.sqrt(F.col("bytes").cast("double"))
    share = root / F.sum(root).over(Window.partitionBy())  # a row for each source
    return sizes.select("source", "bytes", F.greatest(F.lit(1), F.round(share * SHARES)).cast("long").alias("rate"))


def rates_by_weight(sizes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """source, bytes, rate from given weights; a source without one gets the smallest of them."""
    total = sum(weights.values())
    exact = all(isinstance(w, int) for w in weights.values())
    rates = {k: w if exact else max(1, round(w / total * SHARES)) for k, w in weights.items()}
    names = F.create_map(*[F.lit(x) for k, w in rates.items() for x in (k, w)])
    return sizes.select("source", "bytes", F.coalesce(names[F.col("source")], F.lit(min(rates.values()))).cast("long").alias("rate"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _release(k: Column, rate: Column, total: Column) -> Column:
    return _div(k * total, rate)


def _deadline(k: Column, rate: Column, total: Column) -> Column:
    return _div((k + 1) * total + rate - 1, rate)


def period(rates: DataFrame, steps: int = STEPS) -> DataFrame:
    """source, turn, slot: the slots of one period, of as many slots as all rates together, or of the first part that is needed.

    ``rates`` has source, rate, blocks. Earliest deadline first meets all deadlines, so at a period's end each source has had
    its rate of blocks and everything starts again: block k has the slot of block k mod rate, k div rate periods later.

    Slots are given in stretches, each on its own. What a stretch finds is known but for the blocks that are released and
    not yet due: of those as many are done as slots are left, the others wait. Which ones doesn't matter for long: two
    runs that start with different ones done (those due first, in one of them) are the same as soon as these blocks
    are due. So a stretch starts from that guess as many slots earlier as the longest window has, and then is exact.
    """
    plan = rates.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("rate").cast("long").alias("rate"), F.col("blocks").cast("long").alias("blocks")))).alias("s"), F.sum("rate").alias("total"))
    total, far = F.col("total"), F.lit((1 << 62) - 1)

    def block(k: Column, rate: Column) -> Column:
        return F.struct(k.alias("k"), rate.alias("rate"), _release(k, rate, total).alias("release"), _deadline(k, rate, total).alias("deadline"))

    def pick(state: Column, t: Column) -> Column:
        return F.array_min(F.transform(state, lambda x, i: F.struct(F.when(x["release"] <= t, x["deadline"]).otherwise(far).alias("due"), i.alias("i"))))["i"]

    def after(state: Column, i: Column) -> Column:
        return F.transform(state, lambda x, n: F.when(n == i, block(x["k"] + 1, x["rate"])).otherwise(x))

    def slots(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    plan = plan.where("total > 0").withColumn("last", F.least(total, F.array_max(F.transform("s", lambda x: _deadline(x["blocks"] - 1, x["rate"], total)))))
    plan = plan.withColumn("window", F.array_max(F.transform("s", lambda x: _div(total + x["rate"] - 1, x["rate"]) + 1)))
    plan = plan.withColumn("steps", F.least(F.greatest(F.lit(steps), "window"), F.lit(max(steps, MOST_STEPS))).cast("long"))
    each = plan.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("last") - 1, F.col("steps"))))).repartition("n")
    each = each.withColumn("first", F.col("n") * F.col("steps")).withColumn("end", F.least("last", F.col("first") + F.col("steps"))).withColumn("from", F.greatest(F.lit(0), F.col("first") - F.col("window")))
    due = F.transform("s", lambda x: _div(F.col("from") * x["rate"], total))  # blocks that are due by then
    each = each.withColumn("due", due).withColumn("some", F.col("from") - F.aggregate("due", F.lit(0).cast("long"), lambda acc, x: acc + x))
    begun = F.transform(F.arrays_zip("s", "due"), lambda x, i: F.when(_release(x["due"], x["s"]["rate"], total) < F.col("from"), F.struct(_deadline(x["due"], x["s"]["rate"], total).alias("deadline"), i.alias("i"))))
    done = F.transform(F.slice(F.array_sort(F.filter(begun, lambda x: x.isNotNull())), F.lit(1), F.col("some").cast("int")), lambda x: x["i"])
    each = each.withColumn("done", done)
    guess = F.transform(F.arrays_zip("s", "due"), lambda x, i: block(x["due"] + F.when(F.array_contains("done", i), F.lit(1)).otherwise(F.lit(0)), x["s"]["rate"]))
    each = each.withColumn("guess", guess)
    state = F.aggregate(slots(F.col("from"), F.col("first")), F.col("guess"), lambda acc, t: _let(pick(acc, t), lambda i: after(acc, i)))
    each = each.withColumn("state", state)

    def step(acc: Column, t: Column) -> Column:
        return _let(pick(acc["state"], t), lambda i: F.struct(after(acc["state"], i).alias("state"), F.concat(acc["out"], F.array(F.struct(i.alias("i"), F.get(acc["state"], i)["k"].alias("k"), t.alias("slot")))).alias("out")))

    none = F.struct(F.col("state").alias("state"), F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("out"))
    found = each.select("s", F.explode(F.aggregate(slots(F.col("first"), F.col("end")), none, step)["out"]).alias("x"))
    found = found.select(F.get("s", F.col("x.i")).alias("source"), F.col("x.k").alias("turn"), F.col("x.slot").alias("slot"))
    return found.where(F.col("turn") < F.col("source.blocks")).select("source.source", "turn", "slot")


def _slotted(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """``blocks`` (source, block, rate, total and more) with release, deadline and slot."""
    k, rate, total = F.col("block"), F.col("rate"), F.col("total")
    found = blocks.withColumn("turn", k % rate).join(slots.withColumnRenamed("slot", "_in_period"), ["source", "turn"])
    return found.withColumns({"release": _release(k, rate, total), "deadline": _deadline(k, rate, total), "slot": _div(k, rate) * total + F.col("_in_period")}).drop("turn", "_in_period")


def schedule(rates: DataFrame, steps: int = STEPS) -> DataFrame:
    """source, block, release, deadline, slot of the first ``blocks`` blocks of each source (source, rate, blocks).

    Sources that have run out keep their slots, which stay empty.
    """
    total = F.sum("rate").over(Window.partitionBy())  # a row for each source
    every = rates.withColumn("total", total).select("source", F.col("rate").cast("long").alias("rate"), "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    return _slotted(every, period(rates, steps)).select("source", "block", "release", "deadline", "slot")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(records with the bytes of their source before them, bytes of each source)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    ).withColumn("part", F.substring("key", 1, 3))
    parts = save(rows.groupBy("source", "part").agg(F.sum("size").alias("bytes")), "parts")
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("source", "part", F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).cast("long").alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long")).join(base, ["source", "part"])
    placed = placed.select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("before"))
    return placed, save(parts.groupBy("source").agg(F.sum("bytes").alias("bytes")), "sizes")


def _plan(sizes: DataFrame, weights: dict[str, float] | None, block_bytes: int) -> DataFrame:
    """source, rate, total (of all rates), blocks."""
    rates = rates_by_root_share(sizes) if weights is None else rates_by_weight(sizes, weights)
    total = F.sum("rate").over(Window.partitionBy())  # a row for each source
    return rates.select("source", "rate", total.alias("total"), (_div(F.col("bytes") - 1, F.lit(block_bytes).cast("long")) + 1).alias("blocks"))


def _scheduled(docs: DataFrame, weights: dict[str, float] | None, block_bytes: int, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    """A row for each block from a record's first to its last (``whole``: only the first) with block, start, bytes, release, deadline, slot."""
    with scratch(docs.sparkSession):
        placed, sizes = _placed(docs, id_col, text_col, source_col)
        plan = save(_plan(sizes, weights, block_bytes), "plan")
        length = F.lit(block_bytes).cast("long")
        first = _div(F.col("before"), length)
        last = first if whole else _div(F.col("before") + F.col("size") - 1, length)
        pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
        start = F.greatest(F.lit(0), F.col("block") * length - F.col("before"))
        pieces = pieces.withColumn("start", start).withColumn("bytes", F.least(F.col("size"), (F.col("block") + 1) * length - F.col("before")) - F.col("start"))
        slots = save(period(plan), "period")
        found = _slotted(pieces.join(plan.select("source", "rate", "total"), "source"), slots)
        return save(found.select("doc_id", "source", "size", "block", "start", "bytes", "before", "release", "deadline", "slot"), "slots", outlive=True)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with position: their number by slot, then by place in the source."""
    width = rows.groupBy().agg((F.floor(F.coalesce(F.max("slot"), F.lit(0)) / STRETCHES) + 1).alias("width"))
    rows = rows.crossJoin(F.broadcast(width)).withColumn("stretch", F.floor(F.col("slot") / F.col("width"))).drop("width")  # a single row
    counts = rows.groupBy("stretch").agg(F.count("*").alias("n"))
    offset = counts.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))
    number = F.row_number().over(Window.partitionBy("stretch").orderBy("slot", "before", "doc_id", "size")) - 1
    return rows.withColumn("number", number).join(offset, "stretch").withColumn("position", F.col("offset") + F.col("number"))


def mix_blocks(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, block, start, bytes, release, deadline, slot, position (gapless from 0).

    A row for each piece of a record: its bytes from ``start`` on that lie in ``block``.
    """
    rows = _scheduled(docs, weights, block_bytes, id_col, text_col, source_col, whole=False)
    return _numbered(rows).select("doc_id", "source", "size", "block", "start", "bytes", "release", "deadline", "slot", "position")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, block, release, deadline, slot, position (gapless from 0): a row for each whole record."""
    rows = _scheduled(docs, weights, block_bytes, id_col, text_col, source_col, whole=True)
    return _numbered(rows).select("doc_id", "source", "size", "block", "release", "deadline", "slot", "position")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, with all their columns, sorted in mixing order over range partitions."""
    found = mix(docs, weights, block_bytes, id_col, text_col)
    # repeated ids: the n-th row of an id takes the id's n-th position
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("_size"))
    left = left.withColumn("_h", F.xxhash64(F.to_json("_row")))
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_size").orderBy("_h")))
    right = found.select(F.col("doc_id").alias("_id2"), F.col("size").alias("_size2"), "position").withColumn("_n2", F.row_number().over(Window.partitionBy("_id2", "_size2").orderBy("position")))
    joined = left.join(right, left["_id"].eqNullSafe(right["_id2"]) & (left["_size"] == right["_size2"]) & (left["_n"] == right["_n2"]))
    return joined.repartitionByRange("position").sortWithinPartitions("position").select("_row.*")


def in_written_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from Parquet files, with position: a row's place (gapless from 0) in the files, by file name and row number.

    Spark names files by partition, so what :func:`in_order` has written comes back in its order.
    """
    rows = docs.select("*", F.expr("_metadata.file_name").alias("_file"), F.expr("_metadata.row_index").alias("_row"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    counts = rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"))
    offsets = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    return rows.join(F.broadcast(offsets), rows["_file"] == offsets["file"]).select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("before") + F.col("_row")).alias("position"))
