"""Hourly pre-aggregates and reads that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secspark.functions.scalar import hour_ceil, hour_floor
from secspark.model import DEFAULT_ENV
from secspark.sources import files

HOUR = 3600
REMAINDER = "!dim"


def _text(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _env(df: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("env_id"), F.lit("")), F.lit(DEFAULT_ENV)) if "env_id" in df.columns else F.lit(DEFAULT_ENV)


def event_rollup(df: DataFrame, min_sev: int = 3, topn: int = 50) -> DataFrame:
    """Counts by hour, source, severity, action, src_ip, host and environment.

    An address is kept only for rows at or above ``min_sev`` and only if it is among the hour's ``topn`` by
    count (ties by value); all others are folded into ''. Addresses are ranked on the small aggregate, not
    on events, and Spark keeps the first ``topn`` of an hour in each task before it shuffles.
    """
    sev = F.coalesce("severity", F.lit(0))
    flat = df.select(hour_floor(F.col("ts")).alias("bucket"), _text("source", df).alias("source"), sev.alias("severity"), _text("action", df).alias("action"), F.when(sev >= min_sev, _text("src_ip", df)).otherwise("").alias("src_ip"), _text("host", df).alias("host"), _env(df).alias("env_id"), "ts")
    keys = ["bucket", "source", "severity", "action", "src_ip", "host", "env_id"]
    counts = flat.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    totals = counts.where("src_ip <> ''").groupBy("bucket", "env_id", "src_ip").agg(F.sum("n").alias("_total"))
    rank = F.row_number().over(Window.partitionBy("bucket", "env_id").orderBy(F.desc("_total"), "src_ip"))
    best = totals.withColumn("_rank", rank).where(F.col("_rank") <= topn).select("bucket", "env_id", "src_ip", F.lit(True).alias("_kept"))
    marked = counts.join(best, ["bucket", "env_id", "src_ip"], "left").withColumn("src_ip", F.when(F.col("_kept"), F.col("src_ip")).otherwise(""))
    return marked.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


def dim_rollup(df: DataFrame, specs: list[tuple[str, str]], topn: int = 50) -> DataFrame:
    """Counts by hour, source, dimension, value and environment for each (source, dimension).

    The cap keeps the ``topn`` values of an hour, environment and dimension; what it drops is counted in one
    remainder row for each (hour, environment), which is there even when it is 0. ``topn`` <= 0: no cap.
    """
    dims = sorted({d for _, d in specs})
    wanted = F.array(*[F.struct(F.lit(d).alias("dim"), F.when(F.col("source").isin([s for s, x in specs if x == d]), F.coalesce(F.col(d).cast("string") if d in df.columns else F.get_json_object("fields", f"$['{d}']"), F.lit(""))).alias("val")) for d in dims])
    rows = df.select(hour_floor(F.col("ts")).alias("bucket"), "source", _env(df).alias("env_id"), F.explode(wanted).alias("x")).where("x.val <> ''")
    counts = rows.groupBy("bucket", "source", F.col("x.dim").alias("dim"), F.col("x.val").alias("val"), "env_id").agg(F.count("*").alias("n"))
    hours = counts.select("bucket", "env_id").distinct()
    if topn > 0:
        rank = F.row_number().over(Window.partitionBy("bucket", "env_id", "dim").orderBy(F.desc("_total"), "val"))
        totals = counts.groupBy("bucket", "env_id", "dim", "val").agg(F.sum("n").alias("_total")).withColumn("_rank", rank).where(F.col("_rank") <= topn).select("bucket", "env_id", "dim", "val")
        kept = counts.join(totals, ["bucket", "env_id", "dim", "val"], "left_semi")
        lost = counts.join(totals, ["bucket", "env_id", "dim", "val"], "left_anti").groupBy("bucket", "env_id").agg(F.sum("n").alias("n"))
        rest = hours.join(lost, ["bucket", "env_id"], "left")
    else:
        kept, rest = counts, hours.withColumn("n", F.lit(0).cast("long"))
    remainder = rest.select("bucket", F.lit("").alias("source"), F.lit(REMAINDER).alias("dim"), F.lit("").alias("val"), F.coalesce("n", F.lit(0)).alias("n"), "env_id")
    return kept.select(remainder.columns).unionByName(remainder)


#: Registers of a sketch as a power of two; the standard error is 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12


def sketch_rollup(df: DataFrame, column: str, by: list[str], lg_k: int = LG_K) -> DataFrame:
    """bucket, by, sketch: a HyperLogLog sketch of the values of a column for each hour, which merge over hours and keys. Nulls don't count."""
    return df.groupBy(hour_floor(F.col("ts")).alias("bucket"), *by).agg(F.hll_sketch_agg(F.col(column).cast("string"), lg_k).alias("sketch"))


def distinct_from_sketches(rollup: DataFrame, by: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """by, dc: estimated number of distinct values over the hours in [start, end); no event is read again."""
    if start is not None:
        rollup = rollup.where(F.col("bucket") >= start)
    if end is not None:
        rollup = rollup.where(F.col("bucket") < end)
    return rollup.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("dc"))


def host_rollup(events: DataFrame, metrics: DataFrame, snapshots: DataFrame, hot_from: int) -> DataFrame:
    """Per host and environment: last, first, all signals and those since ``hot_from``."""
    every = None
    for d in (events, metrics, snapshots):
        one = d.where("host <> ''").select("host", _env(d).alias("env_id"), "ts")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("host", "env_id").agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.count("*").alias("sig_total"), F.count_if(F.col("ts") >= hot_from).alias("sig_hot"))


def merge_host_rollup(before: DataFrame, new: DataFrame) -> DataFrame:
    """Rollup so far and that of new rows (disjoint): totals add up, hot counts are the new ones."""
    both = before.withColumn("sig_hot", F.lit(0).cast("long")).unionByName(new)
    return both.groupBy("host", "env_id").agg(F.max("last_ts").alias("last_ts"), F.min("first_ts").alias("first_ts"), F.sum("sig_total").alias("sig_total"), F.sum("sig_hot").alias("sig_hot"))


def banned_ip(df: DataFrame, label: str = "action") -> DataFrame:
    """Per (src_ip, source) first and last ban and the newest label."""
    return df.where("src_ip <> ''").groupBy("src_ip", "source").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by(label, F.struct("ts", "id")).alias("label"))


def metric_rollup(df: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(hourly avg, min, max, n of samples before the cutoff; raw samples from it on, and those without a time)."""
    old = F.coalesce(F.col("ts") < cutoff, F.lit(False))
    rolled = df.where(old).groupBy(hour_floor(F.col("ts")).alias("bucket"), "name", "labels", "host").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return rolled, df.where(~old)


def dirty_hours(df: DataFrame, watermark: int, covered_id: int, now: int) -> DataFrame:
    """Hours to rebuild: the current and the last one, and those hit by late rows (id beyond what is covered, ts below the watermark)."""
    late = (F.col("id") > covered_id) & (F.col("ts") < watermark)
    hot = F.col("ts") >= (now // HOUR - 1) * HOUR
    return df.where(late | hot | (F.col("ts") >= watermark)).select(hour_floor(F.col("ts")).alias("bucket")).distinct()


def refresh_rollup(before: DataFrame, df: DataFrame, watermark: int, covered_id: int, now: int, **kw) -> DataFrame:
    """The rollup with its dirty hours built anew; all other hours are taken over."""
    dirty = dirty_hours(df, watermark, covered_id, now)
    again = df.withColumn("_hour", hour_floor(F.col("ts"))).join(dirty, F.col("_hour") == dirty["bucket"], "left_semi").drop("_hour")
    return before.join(dirty, "bucket", "left_anti").unionByName(event_rollup(again, **kw))


LEDGER = "run long, watermark long, covered_id long, hours long"


def covered(spark: SparkSession, ledger: str) -> dict | None:
    """The newest entry of a refresh ledger: what the written rollup knows; None before the first refresh."""
    runs = [int(x.partition("=")[2]) for x in files.children(spark, ledger) if x.startswith("run=")]
    if not runs:
        return None
    return spark.read.schema(LEDGER.partition(", ")[2]).parquet(f"{ledger}/run={max(runs)}").first().asDict() | {"run": max(runs)}


def refresh_written(df: DataFrame, path: str, ledger: str, now: int, hours: DataFrame | None = None, **kw) -> DataFrame:
    """Brings a written rollup (one partition an hour) up to date and returns what was rebuilt: bucket, whether rows are left.

    The ledger says up to which id and time the rollup knows the events. Dirty hours are those of rows beyond the covered
    id, the two hot ones, and ``hours`` (bucket; of late rows or a purge). Only their events are read again, only their
    partitions are written, and those without a row left are deleted; files of other hours are not touched. The ledger's
    entry comes last, so a refresh that broke off is done again in full. Rows without a time are in no hour.
    """
    spark = df.sparkSession
    known = covered(spark, ledger) or {"run": -1, "watermark": None, "covered_id": None}
    at, timed = hour_floor(F.col("ts")), df.where(F.col("ts").isNotNull())
    new = F.lit(True) if known["covered_id"] is None else F.coalesce(F.col("id") > known["covered_id"], F.lit(True))
    # one bounded answer: an hour is a few bytes, and a table has 8,766 of them a year
    fresh = timed.where(new | (F.col("ts") >= (now // HOUR - 1) * HOUR)).groupBy(at.alias("bucket")).agg(F.max("id").alias("id"), F.max("ts").alias("ts")).collect()
    dirty = sorted({r["bucket"] for r in fresh} | ({r["bucket"] for r in hours.select("bucket").distinct().collect()} if hours is not None else set()))
    if not dirty:
        return spark.createDataFrame([], "bucket long, rows boolean")
    listed = spark.createDataFrame([(x,) for x in dirty], "hour long")
    # bounds reach the scan; the join leaves the dirty hours of the span
    again = timed.where(F.col("ts").between(dirty[0], dirty[-1] + HOUR - 1)).join(F.broadcast(listed), at == F.col("hour"), "left_semi")
    event_rollup(again, **kw).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    full = {r["bucket"] for r in again.select(at.alias("bucket")).distinct().collect()}
    for x in sorted(set(dirty) - full):
        files.delete(spark, f"{path}/bucket={x}")
    reach = lambda k, *more: max((x for x in (known[k], *more) if x is not None), default=None)
    entry = (reach("watermark", *(r["ts"] for r in fresh)), reach("covered_id", *(r["id"] for r in fresh)), len(dirty))
    spark.createDataFrame([entry], LEDGER.partition(", ")[2]).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/run={known['run'] + 1}")
    return spark.createDataFrame([(x, x in full) for x in dirty], "bucket long, rows boolean")


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    schema = "source string, severity int, action string, src_ip string, host string, env_id string, n long, last_ts long, bucket long"
    return spark.read.schema(schema).parquet(path).select("bucket", "source", "severity", "action", "src_ip", "host", "env_id", "n", "last_ts")


def merge_rollup_raw(rollup: DataFrame, df: DataFrame, by: list[str], start: int, end: int, watermark: int, covered_id: int) -> DataFrame:
    """Exact counts by source and/or severity in [start, end]: whole rolled hours, raw head and tail, and late rows.

    The four parts are disjoint: rows of rolled hours that the rollup doesn't know yet have an id beyond
    ``covered_id``. Head, tail and late rows come from one scan; without a whole hour all rows are head or tail. A null source or severity is
    '' or 0, as it is in the rollup, so that one key is one row on both sides of the boundary.
    """
    if not set(by) <= {"source", "severity"}:
        raise ValueError("only source and severity are exact in the rollup")
    lo, hi = -(-start // HOUR) * HOUR, min((end + 1) // HOUR, watermark // HOUR) * HOUR
    hi = max(lo, hi)
    body = rollup.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).select(*by, "n")
    one = F.lit(1).cast("long").alias("n")
    outside = (F.col("ts") < lo) | (F.col("ts") >= hi)
    plain = {"source": F.coalesce("source", F.lit("")).alias("source"), "severity": F.coalesce("severity", F.lit(0)).alias("severity")}
    raw = df.where(F.col("ts").between(start, end) & (outside | (F.col("id") > covered_id))).select(*[plain[k] for k in by], one)
    return body.unionByName(raw).groupBy(*by).agg(F.sum("n").alias("count"))


def missing_bands(covered: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Parts of [start, end) outside the covered bands."""
    out, at = [], start
    for a, b in sorted(covered):
        if b <= at or a >= end:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + ([(at, end)] if at < end else [])


def dim_counts(rollup: DataFrame, source: str, dim: str, start: int, end: int, covered: list[tuple[int, int]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(val, count) from whole hours of covered bands, and the bands that are missing."""
    missing = missing_bands(covered, start, end)
    rows = rollup.where((F.col("source") == source) & (F.col("dim") == dim) & (F.col("bucket") >= start) & (F.col("bucket") < end))
    for a, b in missing:
        rows = rows.where(~((F.col("bucket") < b) & (F.col("bucket") + HOUR > a)))
    return rows.groupBy("val").agg(F.sum("n").alias("count")), missing


def cap_report(rollup: DataFrame) -> DataFrame:
    """served, dropped, hours with any row, hours with a remainder, and whether zero loss is proven or unknown."""
    left = F.col("dim") == REMAINDER
    got = rollup.agg(F.coalesce(F.sum(F.when(~left, F.col("n"))), F.lit(0)).alias("served"), F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("dropped"), F.countDistinct(F.when(~left, F.struct("bucket", "env_id"))).alias("hours"), F.countDistinct(F.when(left, F.struct("bucket", "env_id"))).alias("known"))
    state = F.when(F.col("known") < F.col("hours"), "unknown").when(F.col("dropped") == 0, "complete").otherwise("capped")
    return got.withColumn("state", state)


def cold_rollup(cold: DataFrame, day: str, specs: list[tuple[str, str]], **kw) -> tuple[DataFrame, DataFrame]:
    """Both rollups of a sealed day."""
    rows = cold.where(F.col("day") == F.lit(day).cast("date"))
    return event_rollup(rows, **kw), dim_rollup(rows, specs, kw.get("topn", 50))
