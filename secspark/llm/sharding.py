"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, thousands of them. Bytes are summed per slot,
and a versioned map says which shard holds which slot. The first map deals slots, largest first, each
to the shard with the fewest bytes so far. Rebalancing edits the map: slots move from full shards to
those with room and all others stay. The map has one row per slot, whatever the size of the data.

Law: ``bytes``. Everything here is DataFrame expressions; the deal runs as one higher-order
aggregate over the array of slots, whose length is the parameter ``slots``.

Defined results
- size is the UTF-8 bytes of the text (null: none) plus 1;
- a record's slot comes from its id and its text, so null or repeated ids spread over slots;
- records are numbered in their shard by virtual slot, id, checksum and size; equal records may trade
  numbers, and the result has the same rows either way;
- extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty

SLOTS = 4096
SHARDS = 16


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    return rows.withColumn("vslot", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, n, bytes for every slot, empty ones too."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    totals = rows.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return every.join(totals, "vslot", "left").select("vslot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _ordered(totals: DataFrame) -> DataFrame:
    """One row with the slots as an array, largest first. Its length is the number of slots."""
    item = F.struct((-F.col("bytes")).alias("neg"), "vslot", *(["shard"] if "shard" in totals.columns else []))
    return totals.groupBy().agg(F.array_sort(F.collect_list(item)).alias("items"))


def _least(load: Column) -> Column:
    """Zero-based position of the smallest load."""
    return (F.array_position(load, F.array_min(load)) - 1).cast("int")


def _with(load: Column, at: Column, more: Column) -> Column:
    return F.transform(load, lambda x, i: F.when(i == at, x + more).otherwise(x))


def build_map(totals: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """vslot, shard, version: largest slot first, to the shard with the fewest bytes."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.struct(zero.alias("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        to = _least(acc["load"])
        return F.struct(_with(acc["load"], to, -x["neg"]).alias("load"), F.concat(acc["out"], F.array(F.struct(x["vslot"].alias("vslot"), to.alias("shard")))).alias("out"))

    dealt = _ordered(totals).select(F.explode(F.aggregate("items", start, step)["out"]).alias("x"))
    return dealt.select("x.vslot", "x.shard", F.lit(version).alias("version"))


def rebalance(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for ``shards`` shards (more, as many, or fewer).

    A slot stays where it is while its shard has at most its fair share of bytes, counted largest slot
    first; the others, and those of shards that are gone, go to the shard with the fewest bytes.
    """
    rows = totals.join(slot_map, "vslot")
    fair = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("stay", (F.col("shard") < shards) & (held <= fair)).select("vslot", "bytes", "version", F.when(F.col("stay"), F.col("shard")).alias("shard"))
    loads = marked.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("b"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    load = every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("load"))
    moving = _ordered(marked.where("shard is null").drop("shard"))

    def step(acc: Column, x: Column) -> Column:
        to = _least(acc["load"])
        return F.struct(_with(acc["load"], to, -x["neg"]).alias("load"), F.concat(acc["out"], F.array(F.struct(x["vslot"].alias("vslot"), to.alias("shard")))).alias("out"))

    start = F.struct(F.col("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))
    moved = moving.crossJoin(load).select(F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select("x.vslot", "x.shard")  # one row each
    version = slot_map.groupBy().agg((F.max("version") + 1).alias("version"))
    return marked.where("shard is not null").select("vslot", "shard").union(moved).crossJoin(version)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map at ``path``; versions stay side by side."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at ``path``; the newest if none is named."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("vslot", "shard", "version")


def assign(rows: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the record's gapless number in its shard."""
    order = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.join(slot_map, "vslot").select("vslot", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("base"))
    number = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("number", number).join(placed, "vslot").withColumn("slot", F.col("base") + F.col("number")).drop("base", "number")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the virtual slot."""
    rows = slotted(docs, slots, id_col, text_col)
    totals = save(slot_totals(rows, slots), "slots")
    slot_map = save(build_map(totals, shards), "map")
    return assign(rows, totals, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
