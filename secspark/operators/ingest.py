"""Ingest as one flow: landed rows to stored events, in a fixed order.

The order matters: parsers fill the bag before columns are promoted from it, indicators and scopes see values that
processors mask later, an explained change is relabelled before processors look at its severity, and duplicates are told
apart only among rows that processors let through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from secspark.model import DEFAULT_ENV
from secspark.operators import normalize as N
from secspark.sources import files
from secspark.vocabulary import CATEGORIES, MODEL_VERSION


@dataclass(frozen=True)
class Settings:
    """What the steps of ingest need; a step without settings is left out."""

    regex_parsers: tuple[tuple[str, str], ...] = ()
    generic_sources: tuple[str, ...] = ()
    specs: tuple[dict, ...] = ()
    iocs: DataFrame | None = None
    scopes: DataFrame | None = None
    vocabulary: tuple[str, ...] = tuple(CATEGORIES)
    version: str = MODEL_VERSION
    deploys: DataFrame | None = None
    deploy_window_s: int = 3600
    processors: tuple[dict, ...] = ()


def prepared(df: DataFrame) -> DataFrame:
    """``df`` with every column that a step may read; missing ones are null."""
    missing = {c: F.lit(None).cast("int" if c == "severity" else "string") for c in ("source", "category", "severity", "host", "message", "src_ip", "dst_ip", "url", "fields", "dedup") if c not in df.columns}
    env = F.coalesce("env_id", F.lit(DEFAULT_ENV)) if "env_id" in df.columns else F.lit(DEFAULT_ENV)
    return df.withColumns(missing | {"env_id": env})


def normalise(df: DataFrame, s: Settings) -> DataFrame:
    """The row-wise first half: source names, parsers, promoted columns. It runs on a stream as it is."""
    df = N.reserve_source(prepared(df))
    if s.regex_parsers:
        df = N.apply_regex_parsers(df, list(s.regex_parsers))
    if s.generic_sources:
        df = N.extract_generic(df, list(s.generic_sources))
    if s.specs:
        df = N.apply_declarative_parsers(df, list(s.specs))
    return N.promote_columns(df)


def enrich(df: DataFrame, s: Settings, now: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The second half: indicators, scopes, category and version, explained changes, processors.

    Each lookup reads its rows three times, so lookups over one another triple the plan. ``keep`` is what writes the rows before
    each of them and reads them again; without it the plan is made as it stands.
    """
    if s.iocs is not None:
        df = N.match_iocs(keep(df), s.iocs, now)
    if s.scopes is not None:
        df = N.tag_scope(keep(df), s.scopes)
    df = N.stamp_version(N.resolve_category(df, list(s.vocabulary)), s.version)
    if s.deploys is not None:
        df = N.relabel_corroborated(keep(df), s.deploys, s.deploy_window_s)
    return N.apply_processors(df, list(s.processors)) if s.processors else df


def ingest(df: DataFrame, s: Settings, now: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stored events of a batch of landed rows; for ``keep`` see :func:`enrich`."""
    return N.dedup_events(keep(enrich(normalise(df, s), s, now, keep)))


def ingest_stream(landed: DataFrame, s: Settings, now, path: str, checkpoint: str, within_s: int = 7 * 86400) -> DataStreamWriter:
    """Ingests a stream to ``path``/rows, one partition a batch; ``now`` is called for each batch.

    Keys of stored rows stand in ``path``/keys by day: a batch looks up those of its own days and ``within_s`` seconds before, so its
    cost doesn't grow with what is stored; an older duplicate is stored again. A batch that runs again replaces what it wrote.
    Rows between two steps stand in ``path``/steps until the batch is stored, so that each plan is as small as its step.
    """

    def step(df: DataFrame, n: int) -> None:
        spark, made = df.sparkSession, []

        def keep(rows: DataFrame) -> DataFrame:
            made.append(f"{path}/steps/batch={n}/{len(made)}")
            rows.write.mode("overwrite").parquet(made[-1])
            if len(made) > 1:
                files.delete(spark, made[-2])
            return spark.read.schema(rows.schema).parquet(made[-1])

        fresh = ingest(df, s, now(), keep)
        first = df.agg(F.min("ts")).first()[0]
        if n and first is not None and files.exists(spark, f"{path}/keys"):
            known = spark.read.schema("host string, dedup string, day date, batch int").parquet(f"{path}/keys")
            known = known.where((F.col("batch") < n) & (F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(first - within_s)))))
            seen = known.select(F.col("host").alias("_host"), F.col("dedup").alias("_dedup")).distinct()
            fresh = fresh.join(seen, F.col("host").eqNullSafe(F.col("_host")) & (F.col("dedup") == F.col("_dedup")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        stored = spark.read.parquet(f"{path}/rows/batch={n}").where("dedup is not null")
        keys = stored.select("host", "dedup", F.to_date(F.timestamp_seconds("ts")).alias("day"), F.lit(n).alias("batch"))
        keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/keys")
        files.delete(spark, f"{path}/steps/batch={n}")

    return landed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
