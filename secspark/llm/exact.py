"""Exact dedup: a tree-merge of sorted digest runs.

A run is what some input partitions hold, sorted by digest: (digest, length, second hash, smallest or
largest id, count). Runs are merged in binomial rounds: in round r the runs whose number has bit r set
are sent to the run without it (i + 2^r to i), so ``runs`` runs take ceil(log2 runs) rounds. In a round
each task sorts its part of a run and combines equal digests before sending; the receiver merges the
sorted stretches of both runs and keeps one verified identifier for each digest, by a sort aggregate
that streams over neighbours. All parts of the digest space are merged side by side, so no task ever
holds a whole run of the corpus, and a hot text reaches a merge as one row from each task.

Defined results
- null text counts as empty; empty texts form a group like any other;
- ids tie-break by value; a null id never stays while the group has another id;
- repeated rows with the same id and text: all have the same keep_id, and all of them are marked kept
  (``exact_dedup(...)`` returns a single one);
- digests are verified by byte length and a second 64-bit hash, which are part of the merge key;
- extra columns stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_or_empty

RUNS = 16
_KEY = ["digest", "n_bytes", "h2"]


def _digest(text: Column) -> list[Column]:
    # never null, and declared so: Spark would hash every text once more to filter null keys before a join
    return [F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("h2")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the UTF-8 text), n_bytes and a second hash."""
    return docs.select(F.col(id_col).alias("doc_id"), *_digest(text_or_empty(text_col)))


def merge_runs(rows: DataFrame, keep: str = "max", runs: int = RUNS) -> DataFrame:
    """Merge (doc_id, digest, n_bytes, h2) to one row per text: digest, n_bytes, h2, keep_id, group_size."""
    # the flag puts null ids last in either direction
    pick, flag = {"max": (F.max, F.col("doc_id").isNotNull()), "min": (F.min, F.col("doc_id").isNull())}[keep]
    level = rows.select((F.spark_partition_id() % runs).alias("run"), *_KEY, F.struct(flag.alias("flag"), F.col("doc_id").alias("id")).alias("keep"), F.lit(1).cast("long").alias("group_size"))
    for r in range(max(1, (runs - 1).bit_length())):
        sent = level.withColumn("run", F.col("run").bitwiseAND(F.lit(~(1 << r))))
        # ids in a struct: Spark then aggregates sorted input, as it does for the sorted runs it exchanges
        level = sent.groupBy("run", *_KEY).agg(pick("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return level.select(*_KEY, F.col("keep.id").alias("keep_id"), "group_size")


def duplicate_groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    groups = save(merge_runs(rows, keep), "runs")
    same: Column = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, _KEY).select("doc_id", "keep_id", "group_size", same.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one for each text."""
    # ids in a struct: null ids are equal there, so that join and dropDuplicates share one exchange of whole rows
    stays = [*_KEY, "id"]
    groups = save(merge_runs(digests(docs, id_col, text_col), keep), "runs").select(*_KEY, F.struct(F.col("keep_id").alias("id")).alias("id"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(id_col).alias("id")).alias("id"), *_digest(text_or_empty(text_col)))
    return left.join(groups, stays, "left_semi").dropDuplicates(stays).select("row.*")
