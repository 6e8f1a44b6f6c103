"""Governance of data: masks, retention, holds, purges, chain checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secspark.functions.scalar import unused
from secspark.model import DEFAULT_ENV
from secspark.sources import files

FLOOR_DAYS, CEILING_DAYS, DAY = 7, 3650, 86400
#: A hold over so many days or more stands under one key for all days.
DAYS = 400
MASKS = {"deny": 0, "redact": 1, "mask": 2, "hash": 3, "partial": 4}


def resolve_masks(rules: list[dict], role: str | None, tenant: str, env: str, known_roles: set[str]) -> dict[str, str]:
    """field -> mask for a caller. ``rules``: field, mask, and optional role, tenant, env (absent: all).

    The most specific rule of a field wins; deny always wins; an unknown role gets every mask there is.
    """
    best: dict[str, tuple[int, str]] = {}
    for r in rules:
        if role in known_roles:
            if any(r.get(k) not in (None, v) for k, v in (("role", role), ("tenant", tenant), ("env", env))):
                continue
        elif r["mask"] == "clear":
            continue
        weight = sum(r.get(k) is not None for k in ("role", "tenant", "env"))
        if r["mask"] == "deny":
            weight = 99
        if r["field"] not in best or weight > best[r["field"]][0] or (weight == best[r["field"]][0] and MASKS.get(r["mask"], 1) < MASKS.get(best[r["field"]][1], 1)):
            best[r["field"]] = (weight, r["mask"])
    return {f: m for f, (_, m) in best.items() if m != "clear"}


def masked(c: Column, mask: str, salt: str = "") -> Column:
    s = c.cast("string")
    if mask == "mask":
        return F.when(s.isNotNull(), "***")
    if mask == "partial":
        return F.concat(F.lit("***"), F.right(s, F.lit(4)))
    if mask == "hash":
        return F.substring(F.sha2(F.concat(F.encode(F.lit(salt), "UTF-8"), F.lit(b"\x00"), F.encode(s, "UTF-8")), 256), 1, 16)
    return F.lit(None).cast("string")


def apply_masks(df: DataFrame, masks: dict[str, str], salt: str = "") -> DataFrame:
    """Masks on columns and on bag members, at the scan: aggregates only ever see masked values."""
    columns = {f: masked(F.col(f), m, salt) for f, m in masks.items() if f in df.columns}
    inner = {f: m for f, m in masks.items() if f not in df.columns}
    if inner and "fields" in df.columns and "fields" not in columns:
        value = F.from_json("fields", "map<string,string>")

        def one(k: Column, v: Column) -> Column:
            out = v
            for f, m in inner.items():
                out = F.when(k == f, masked(v, m, salt)).otherwise(out)
            return out

        columns["fields"] = F.when(F.col("fields").isNotNull(), F.to_json(F.map_filter(F.transform_values(value, one), lambda k, v: v.isNotNull())))
    return df.withColumns(columns)


def check_references(referenced: set[str], masks: dict[str, str]) -> None:
    """A filter on a masked field would leak it through row counts: refused before a plan is built."""
    hidden = sorted(referenced & set(masks))
    if hidden:
        raise PermissionError(f"filter on masked fields: {', '.join(hidden)}")


def _referred(df: DataFrame, what: Column | str | None, inner: set[str]) -> set[str]:
    """Columns of ``df`` that an expression refers to, and which of the masked members of the bag (``inner``) it may read."""
    if what is None:
        return set()
    plan = df.select(F.col(what) if isinstance(what, str) else what)._jdf.queryExecution().analyzed()
    refs = plan.references().toSeq()
    names = {refs.apply(i).name() for i in range(refs.size())}
    if "fields" in names and inner:
        text = plan.expressions().mkString(" ")
        paths = set(re.findall(r"\$(?:\['|\.|\[\")(\w+)", text))
        # whoever takes the bag as a whole can read every member
        names |= inner & paths if text.count("fields#") <= len(re.findall(r"get_json_object\([^()]*fields#", text)) else inner
    return names


def under_masks(search, masks: dict[str, str], salt: str = "") -> DataFrame:
    """A recorded search run again over masked rows: values are masked at the scan, before any stage sees them.

    Masked fields are followed through the stages: what is renamed, computed, extracted or aggregated from one is masked as
    well. A stage that filters by such a column (search, where, exclude, join) raises PermissionError, as row counts would
    leak values; grouping, sorting and lookups see masked values only. Searches that are joined or appended run under the same masks.
    """
    df, hidden = apply_masks(search.df if search.base is None else search.base, masks, salt), set(masks)
    inner = {m for m in masks if m not in df.columns}
    for (_, step), note in zip(search.stages, search.notes):
        for f in note.filters:
            check_references(_referred(df, f, inner) & hidden, dict.fromkeys(hidden, ""))
        made = set()
        for name, what in note.made:
            columns = [name] if name else df.groupBy().agg(what).columns
            made |= {(c, bool(_referred(df, what, inner) & hidden)) for c in columns}
        if note.sub is not None:
            right = note.sub if isinstance(note.sub, DataFrame) else under_masks(note.sub, masks, salt)
            # of a plain frame, columns with masked names are masked here
            df = note.again(df, apply_masks(right, {k: m for k, m in masks.items() if k in right.columns}, salt) if isinstance(note.sub, DataFrame) else right)
        else:
            df = step(df)
        hidden = {new for new, old in note.renamed if old in hidden} | (hidden - {old for _, old in note.renamed})
        hidden = (hidden - {c for c, _ in made}) | {c for c, bad in made if bad} | inner
        if note.only is not None:
            hidden &= set(df.columns) | inner
    return df


def _under_hold(df: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of the equi-join of rows and active holds, and its condition.

    A hold stands under its source, or under one key for all sources, and under the days its span touches: up to ``DAYS``
    of them one by one, else one key for all days. A row looks under the four keys that are its own. So rows meet only the
    holds of their source and day, and the long ones; the exact test comes after.
    """
    lo, hi = F.floor(F.col("scope_start_ts") / DAY), F.floor(F.col("scope_end_ts") / DAY)
    some = lo.isNotNull() & hi.isNotNull() & (hi - lo < DAYS)
    days = F.when(some, F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))).otherwise(F.array(F.lit(None).cast("long")))
    keyed = holds.where(F.coalesce(F.col("active"), F.lit(False))).select("scope_source", "scope_start_ts", "scope_end_ts", F.explode(days).alias("_day"))
    keyed = keyed.withColumn("_key", F.concat_ws("|", F.coalesce(F.concat(F.lit("="), "scope_source"), F.lit("*")), F.coalesce(F.col("_day").cast("string"), F.lit("*"))))
    day = F.floor(F.col("ts") / DAY).cast("string")
    own = [F.concat_ws("|", s, d) for s in (F.lit("*"), F.concat(F.lit("="), "source")) for d in (F.lit("*"), day)]
    test = (F.col("scope_source").isNull() | F.col("scope_source").eqNullSafe(F.col("source"))) & (F.col("scope_start_ts").isNull() | (F.col("ts") >= F.col("scope_start_ts"))) & (F.col("scope_end_ts").isNull() | (F.col("ts") <= F.col("scope_end_ts")))
    return own, keyed.select("_key", "scope_source", "scope_start_ts", "scope_end_ts"), test


def _split_by_holds(df: DataFrame, holds: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) a hold. Rows are not multiplied: each of the four keys is a join of its own."""
    own, keyed, test = _under_hold(df, holds)
    if how == "left_anti":
        for key in own:
            df = df.join(keyed, (key == F.col("_key")) & test, "left_anti")
        return df
    out, rest = None, df
    for key in own:
        hit = rest.join(keyed, (key == F.col("_key")) & test, "left_semi")
        out, rest = hit if out is None else out.unionByName(hit), rest.join(keyed, (key == F.col("_key")) & test, "left_anti")
    return out


def held(df: DataFrame, holds: DataFrame | None) -> DataFrame:
    """Rows under an active legal hold (scope_source null: every source; open bounds are null); without readable holds, all.

    A row without a time or source is under the holds that ask for none.
    """
    return df if holds is None else _split_by_holds(df, holds, "left_semi")


def legal_hold_filter(candidates: DataFrame, holds: DataFrame | None) -> DataFrame:
    """Rows that may be deleted; without readable holds, none."""
    return candidates.where(F.lit(False)) if holds is None else _split_by_holds(candidates, holds, "left_anti")


def _expired(df: DataFrame, policies: dict[str, int], global_days: int, now: int, control_sources: list[str]) -> Column:
    clamp = lambda n: min(max(n, FLOOR_DAYS), CEILING_DAYS)
    env = F.coalesce("env_id", F.lit(DEFAULT_ENV)) if "env_id" in df.columns else F.lit(DEFAULT_ENV)
    days = F.lit(clamp(global_days))
    for name, n in sorted(policies.items()):
        days = F.when(env == name, clamp(n)).otherwise(days)
    old = (F.col("ts") < F.lit(now) - days * DAY) & ~F.coalesce(F.col("source").isin(list(control_sources)), F.lit(False))
    return F.coalesce(old, F.lit(False))


def retain(df: DataFrame, policies: dict[str, int], global_days: int, holds: DataFrame | None, now: int, control_sources: list[str] = ()) -> DataFrame:
    """Rows that stay: inside their environment's limit (days, between floor and ceiling), control rows, held rows, rows without a time."""
    if holds is None:
        return df
    old = _expired(df, policies, global_days, now, control_sources)
    return df.where(~old).unionByName(held(df.where(old), holds))


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows of each environment."""
    rank = F.row_number().over(Window.partitionBy("env_id").orderBy(F.desc("ts"), F.desc("id")))
    name = unused(df, "_n")
    return df.withColumn(name, rank).where(F.col(name) <= n).drop(name)


def cap_bytes(df: DataFrame, n: int, size: Column) -> DataFrame:
    """Newest rows of each environment within ``n`` bytes.

    Bytes are first summed by environment and hour; only rows of the hours around the limit are ordered, so
    no environment has to pass through one task row by row.
    """
    columns = [F.col(f"`{c}`").alias(c) for c in df.columns]
    # a struct is never null, so rows without an environment are capped among themselves
    at = F.struct("env_id", F.floor(F.col("ts") / 3600).alias("hour"))
    rows = df.select(F.struct(*columns).alias("row"), at.alias("at"), "ts", "id", size.cast("long").alias("size"))
    newer = Window.partitionBy("of.env_id").orderBy(F.desc("of.hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy(F.col("at").alias("of")).agg(F.sum("size").alias("held"))
    hours = hours.withColumn("before", F.coalesce(F.sum("held").over(newer), F.lit(0))).where(F.col("before") <= n)
    inside = rows.join(hours, F.col("at") == F.col("of"))
    w = Window.partitionBy("at").orderBy(F.desc("ts"), F.desc("id"))
    running = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("running", running).where(F.col("running") <= n).select("row.*")


def _scope(scope: dict) -> Column:
    start, end = scope.get("start"), scope.get("end")
    picks = [F.col(k) == v for k, v in sorted(scope.items()) if k in ("source", "host", "src_ip", "env_id", "category") and v]
    if not picks:
        raise ValueError("a purge needs at least one selector")
    if start is None or end is None or start > end:
        raise ValueError("a purge needs a window")
    return reduce(lambda a, b: a & b, picks, F.col("ts").between(start, end))


def _purge_counts(df: DataFrame, scope: dict) -> DataFrame:
    return df.where(_scope(scope)).groupBy("source").agg(
        F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.bit_xor(F.xxhash64("id", "ts")).alias("digest"),
    )


def purge_plan(df: DataFrame, scope: dict, samples: int = 5) -> DataFrame:
    """By source: count, id and ts bounds, sample ids, and a digest of the rows that would go.

    The sample is the ``samples`` oldest and newest rows of the whole scope by (ts, id); each of them stands
    with its source, in that order. A source without a row at either end has an empty sample.
    """
    rows = df.where(_scope(scope)).select("source", "ts", "id")
    ends = rows.orderBy("ts", "id").limit(samples).union(rows.orderBy(F.desc("ts"), F.desc("id")).limit(samples)).distinct()
    ends = ends.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ts", "id")))["id"].alias("samples")).withColumnRenamed("source", "_source")
    counts = _purge_counts(df, scope)
    joined = counts.join(ends, counts["source"].eqNullSafe(ends["_source"]), "left").drop("_source")
    return joined.withColumn("samples", F.coalesce("samples", F.array().cast("array<long>")))


def plan_digest(plan: DataFrame) -> DataFrame:
    """A single row: n, digest of a whole plan."""
    return plan.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("digest"), F.lit(0)).alias("digest"))


def _unpurged(df: DataFrame, scope: dict, holds: DataFrame | None) -> DataFrame:
    return df.where(~F.coalesce(_scope(scope), F.lit(False))).unionByName(held(df.where(_scope(scope)), holds))


def purge_apply(df: DataFrame, scope: dict, digest: tuple[int, int], holds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, hours to rebuild), if the plan still has the digest; held rows stay, without readable holds all do."""
    now = plan_digest(_purge_counts(df, scope)).first()
    if (now["n"], now["digest"]) != tuple(digest):
        raise RuntimeError("the rows have changed since the plan was made")
    going = legal_hold_filter(df.where(_scope(scope)), holds)
    hours = going.select((F.floor(F.col("ts") / 3600) * 3600).alias("bucket")).distinct()
    return _unpurged(df, scope, holds), hours


PROOF = "files long, rows_before long, rows_gone long, rows_after long, digest_before long, digest_after long"


def _row_digest(columns: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in columns])), F.lit(0)).alias("digest")]


def rewrite_without(spark: SparkSession, path: str, schema: str, doomed: Callable[[DataFrame], DataFrame], stay: Callable[[DataFrame], DataFrame], work: str, partition_by: list[str] = ()) -> DataFrame:
    """Takes the doomed rows out of a written table; returns the proof, one row.

    ``doomed`` gives the rows that go out of a frame of the table's rows, ``stay`` all others. Only files that hold a doomed row
    are rewritten, in these steps: the rows that stay go to a staged copy in ``work``; their number and digest in the old files
    must equal those in the staged ones, and with the doomed rows make up the old files; a manifest of the old files and the new
    ones is written; the new files are moved in, the old ones deleted. A run that breaks off before the manifest has changed
    nothing; after it, :func:`finish_rewrite` ends it. Readers should wait while files are swapped. A partition with many rows
    is dealt over several tasks and files.
    """
    if files.exists(spark, f"{work}/manifest"):
        raise RuntimeError("an earlier rewrite has not ended: call finish_rewrite")
    table = spark.read.schema(schema).parquet(path)
    columns = table.columns
    named = table.withColumn("_file", F.expr("_metadata.file_path"))
    root = urlsplit(files.qualified(spark, path)).path + "/"
    # names of files, not rows; file_path is a URI, and the folders below the root have the partition columns
    touched = sorted(unquote(urlsplit(r["_file"]).path)[len(root) :] for r in doomed(named).select("_file").distinct().collect())
    files.delete(spark, f"{work}/staged")
    empty = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], PROOF)
    if not touched:
        return empty
    read = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{x}" for x in touched])
    going = doomed(read)
    before, gone = read.agg(*_row_digest(columns)).first(), going.agg(*_row_digest(columns)).first()
    left = stay(read)
    if partition_by:
        left = left.hint("rebalance", *partition_by)
    left.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(f"{work}/staged")
    staged = spark.read.schema(schema).parquet(f"{work}/staged").agg(*_row_digest(columns)).first()
    if staged["n"] + gone["n"] != before["n"] or staged["digest"] ^ gone["digest"] != before["digest"]:
        files.delete(spark, f"{work}/staged")
        raise RuntimeError("the staged rows and the doomed rows don't make up the old files")
    old = [(x, False) for x in touched]
    new = [(x, True) for x in files.data_files(spark, f"{work}/staged")]
    proof = (len(touched), before["n"], gone["n"], staged["n"], before["digest"] ^ gone["digest"], staged["digest"])
    spark.createDataFrame([proof], PROOF).coalesce(1).write.mode("overwrite").parquet(f"{work}/proof")
    spark.createDataFrame(old + new, "name string, staged boolean").coalesce(1).write.parquet(f"{work}/manifest")
    return finish_rewrite(spark, path, work)


def finish_rewrite(spark: SparkSession, path: str, work: str) -> DataFrame:
    """Ends a rewrite from its manifest, as often as it takes; returns the proof."""
    if files.exists(spark, f"{work}/manifest"):
        listed = spark.read.schema("name string, staged boolean").parquet(f"{work}/manifest").collect()
        for r in sorted(x["name"] for x in listed if x["staged"]):
            files.move(spark, f"{work}/staged/{r}", f"{path}/{r}")
        for r in sorted(x["name"] for x in listed if not x["staged"]):
            files.delete(spark, f"{path}/{r}")
        files.delete(spark, f"{work}/staged")
        files.delete(spark, f"{work}/manifest")
    return spark.read.schema(PROOF).parquet(f"{work}/proof")


def _written_holds(spark: SparkSession, holds: DataFrame | None, work: str) -> DataFrame | None:
    """The active holds as files: every step sees the same ones, and Spark knows their size, so that few of them are broadcast and rows aren't shuffled by their keys."""
    if holds is None:
        return None
    active = holds.where(F.coalesce(F.col("active"), F.lit(False))).select("scope_source", "scope_start_ts", "scope_end_ts", "active")
    active.write.mode("overwrite").parquet(f"{work}/holds")
    return spark.read.schema(active.schema).parquet(f"{work}/holds")


def purge_written(spark: SparkSession, path: str, schema: str, scope: dict, digest: tuple[int, int], holds: DataFrame | None, work: str, partition_by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(proof, hours to rebuild): a purge of a written table, if its plan still has the digest. Held rows and rows without a time stay."""
    table = spark.read.schema(schema).parquet(path)
    now = plan_digest(_purge_counts(table, scope)).first()
    if (now["n"], now["digest"]) != tuple(digest):
        raise RuntimeError("the rows have changed since the plan was made")
    holds = _written_holds(spark, holds, work)
    doomed = lambda df: legal_hold_filter(df.where(_scope(scope)), holds)
    stay = lambda df: _unpurged(df, scope, holds)
    return _rewrite_and_hours(spark, path, schema, doomed, stay, work, partition_by)


def retain_written(
    spark: SparkSession, path: str, schema: str, policies: dict[str, int], global_days: int, holds: DataFrame | None, now: int, control_sources: list[str], work: str, partition_by: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(proof, hours to rebuild): :func:`retain` on a written table."""
    holds = _written_holds(spark, holds, work)
    doomed = lambda df: legal_hold_filter(df.where(_expired(df, policies, global_days, now, control_sources)), holds)
    stay = lambda df: retain(df, policies, global_days, holds, now, control_sources)
    return _rewrite_and_hours(spark, path, schema, doomed, stay, work, partition_by)


def _rewrite_and_hours(spark: SparkSession, path: str, schema: str, doomed: Callable[[DataFrame], DataFrame], stay: Callable[[DataFrame], DataFrame], work: str, partition_by: list[str]) -> tuple[DataFrame, DataFrame]:
    going = doomed(spark.read.schema(schema).parquet(path)).select((F.floor(F.col("ts") / 3600) * 3600).alias("bucket")).distinct()
    going.write.mode("overwrite").parquet(f"{work}/hours")  # before the rows are gone
    proof = rewrite_without(spark, path, schema, doomed, stay, work, partition_by)
    return proof, spark.read.schema("bucket long").parquet(f"{work}/hours")


def chain_hash(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, F.col("ts").cast("string"), "kind", "detail"), 256)


def verify_chain(ledger: DataFrame, chain: str | None = None) -> DataFrame:
    """first_broken: smallest id whose hash or link is wrong (null: none), for each chain if ``chain`` names a column.

    The link to the previous row is found by a join of (id rank); without a chain column ids are dealt into
    stretches, so that the window runs in parallel and only stretch edges are compared in one task.
    """
    keys = [chain] if chain else []
    width = 100_000
    rows = ledger.withColumn("_s", F.floor(F.col("id") / width))
    own = F.lag("hash").over(Window.partitionBy(*keys, "_s").orderBy("id"))
    rows = rows.withColumn("_prev", own)
    last = rows.groupBy(*keys, "_s").agg(F.max_by("hash", "id").alias("_last"))
    edges = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_s"))).select(*keys, "_s", "_before")
    linked = rows.join(edges, [*keys, "_s"]).withColumn("_prev", F.coalesce("_prev", "_before", F.lit("")))
    bad = (F.coalesce("prev_hash", F.lit("")) != F.col("_prev")) | (F.col("hash") != chain_hash(F.coalesce("prev_hash", F.lit(""))))
    return linked.groupBy(*keys).agg(F.min(F.when(F.coalesce(bad, F.lit(True)), F.col("id"))).alias("first_broken"))


def index_stats(rollup: DataFrame) -> DataFrame:
    """Per environment: rows, oldest hour, last ts, from the event rollup."""
    return rollup.groupBy("env_id").agg(F.sum("n").alias("n"), F.min("bucket").alias("oldest"), F.max("last_ts").alias("last_ts"))
