"""Writers: the cold tier, exports, forwarding, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.model import DEFAULT_ENV


def with_day(df: DataFrame) -> DataFrame:
    """env_id without nulls, and the UTC day."""
    env = F.coalesce(F.nullif(F.col("env_id"), F.lit("")), F.lit(DEFAULT_ENV)) if "env_id" in df.columns else F.lit(DEFAULT_ENV)
    return df.withColumns({"env_id": env, "day": F.to_date(F.timestamp_seconds("ts"))})


def write_cold(df: DataFrame, path: str, hot_from: int, files_per_day: int = 1) -> None:
    """Rows older than ``hot_from`` to one folder for each environment and day, sorted by ts.

    Days that are written replace what stood there, others stay. A busy day is dealt over
    ``files_per_day`` tasks by hour, so that it never has to fit one.
    """
    rows = with_day(df).where(F.col("ts") < hot_from)
    part = F.pmod(F.floor(F.col("ts") / 3600), F.lit(files_per_day))
    sorted_ = rows.repartition("env_id", "day", part).sortWithinPartitions("env_id", "day", "ts")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("env_id", "day").parquet(path)


def verify_cold(cold: DataFrame, expected: DataFrame) -> DataFrame:
    """env_id, day, expected, found, ok: row counts and key digests by folder, before hot rows are deleted."""
    digest = lambda d: with_day(d).groupBy("env_id", "day").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "ts")).alias("x"))
    a, b = digest(expected), digest(cold)
    joined = a.select("env_id", "day", F.col("n").alias("expected"), F.col("x").alias("_x")).join(b.select("env_id", "day", F.col("n").alias("found"), F.col("x").alias("_y")), ["env_id", "day"], "full")
    return joined.select("env_id", "day", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), (F.col("expected").eqNullSafe(F.col("found")) & F.col("_x").eqNullSafe(F.col("_y"))).alias("ok"))


def guard(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(c.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_rows(df: DataFrame) -> DataFrame:
    """All columns as guarded text."""
    return df.select(*[guard(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """line: each row as a CSV line without its end."""
    quoted = lambda c: F.when(c.isNull(), "").when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    safe = csv_rows(df)
    return safe.select(F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in safe.columns]).alias("line"))


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV files with a header and CRLF. Beyond ``limit`` rows a last file row says so."""
    rows = csv_rows(df)
    if limit is not None:
        more = rows.limit(limit + 1).count() > limit
        rows = rows.limit(limit)
        if more:
            rows = rows.union(rows.sparkSession.range(1).select(F.lit("# truncated").alias(rows.columns[0]), *[F.lit(None).cast("string").alias(c) for c in rows.columns[1:]]))
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", False).option("escape", '"').csv(path)


def export_records(df: DataFrame) -> DataFrame:
    """record: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))


# Syslog level by severity 0 to 4.
SYSLOG_LEVEL = [6, 5, 4, 3, 2]


def render(df: DataFrame, fmt: str) -> Column:
    """A row as an RFC 5424 line, a collector record or a webhook body."""
    if fmt == "rfc5424":
        level = F.coalesce(F.get(F.array(*[F.lit(x) for x in SYSLOG_LEVEL]), F.col("severity")), F.lit(6))
        stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        token = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.col(c), r"\s+", "_"), F.lit("")), F.lit("-"))
        return F.concat(F.lit("<"), (level + 8).cast("string"), F.lit(">1 "), stamp, F.lit(" "), token("host"), F.lit(" "), token("source"), F.lit(" - - - "), F.coalesce(F.regexp_replace("message", r"[\r\n]+", " "), F.lit("")))
    if fmt == "collector":
        return F.to_json(F.struct(F.col("ts").alias("time"), "host", "source", F.struct("message", "severity", "fields").alias("event")))
    return F.to_json(F.struct(*df.columns))


def forward(df: DataFrame, predicate: Column, fmt: str, watermark: int) -> DataFrame:
    """id, body of matching rows after the watermark, in id order. The new watermark is the largest id that was sent."""
    return df.where(predicate & (F.col("id") > watermark)).select("id", render(df, fmt).alias("body")).orderBy("id")


def upsert_lookup(table: DataFrame, alerts: DataFrame, name: str, key: str) -> DataFrame:
    """The lookup table with the newest alert of each key in it."""
    rest = [c for c in alerts.columns if c != key]
    newest = alerts.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max_by(F.to_json(F.struct(*rest)), F.struct("ts", "id")).alias("val")).select(F.lit(name).alias("name"), "key", "val")
    return table.join(newest, ["name", "key"], "left_anti").unionByName(newest)
