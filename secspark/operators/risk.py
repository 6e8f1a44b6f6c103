"""Risk: contributions by entity, their rollup, incidents and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secspark.functions.scalar import bucket, hour_floor, parent_technique

DAY, HOUR = 86400, 3600
SCORE, TACTICS, VELOCITY = 100, 3, 50
KEYS = ["entity_type", "entity"]


def risk_contributions(df: DataFrame, rule: dict) -> DataFrame:
    """One row for each entity and rule window: entity_type, entity, ts, risk_score, rule, severity, mitre, dedup."""
    b = bucket(F.col("ts"), rule["window_s"]).alias("bucket")
    got = df.where(F.col(rule["risk_entity_field"]).isNotNull()).groupBy(F.col(rule["risk_entity_field"]).cast("string").alias("entity"), b).agg(F.max("ts").alias("ts"), F.max("severity").alias("severity"))
    return got.select(F.lit(rule["risk_entity_type"]).alias("entity_type"), "entity", "ts", F.lit(rule["risk_score"]).alias("risk_score"), F.lit(rule["name"]).alias("rule"), "severity", F.lit(rule.get("mitre", "")).alias("mitre"), F.concat_ws("|", F.lit(rule["name"]), "entity", F.col("bucket").cast("string")).alias("dedup"))


def risk_from_iocs(matched: DataFrame, points: dict[int, int] | None = None) -> DataFrame:
    """One contribution for each matched indicator and hour; points by severity."""
    points = points or {0: 5, 1: 10, 2: 20, 3: 40, 4: 60}
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    got = matched.where("threat_intel").groupBy(F.col("ti_match").alias("entity"), hour_floor(F.col("ts")).alias("hour")).agg(F.max("ts").alias("ts"), F.max("ti_severity").alias("severity"))
    return got.select(F.lit("ioc").alias("entity_type"), "entity", "ts", F.coalesce(table[F.col("severity")], F.lit(10)).alias("risk_score"), F.lit("threat-intel").alias("rule"), "severity", F.lit("").alias("mitre"), F.concat_ws("|", F.lit("ti"), "entity", F.col("hour").cast("string")).alias("dedup"))


def attack_tactic(df: DataFrame, tactics: DataFrame, column: str = "mitre") -> DataFrame:
    """``df`` with technique (the parent) and its tactic. ``tactics``: technique, tactic.

    A technique outside the table stands for itself, so that tactics are never undercounted; without a technique
    there is none.
    """
    named = df.withColumn("technique", parent_technique(F.col(column))).join(tactics, "technique", "left")
    return named.withColumn("tactic", F.coalesce("tactic", F.nullif(F.trim(column), F.lit(""))))


def risk_rollup(contributions: DataFrame, tactics: DataFrame, now: int) -> DataFrame:
    """Per entity over 24 hours: score, contributions, tactics, hot score (1 hour), severity, first and last.

    ``tactics``: technique, tactic.
    """
    named = attack_tactic(contributions.where((F.col("ts") > now - DAY) & (F.col("ts") <= now)), tactics)
    return named.groupBy(*KEYS).agg(
        F.sum("risk_score").alias("score"), F.count("*").alias("contributions"), F.countDistinct("tactic").alias("n_tactics"), F.array_sort(F.collect_set("tactic")).alias("tactics"),
        F.sum(F.when(F.col("ts") > now - HOUR, F.col("risk_score")).otherwise(0)).alias("hot_score"), F.max("severity").alias("max_severity"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def risk_incidents(rollup: DataFrame, score: int = SCORE, tactics: int = TACTICS, velocity: int = VELOCITY) -> DataFrame:
    """Entities over a limit, with severity and the reasons in words."""
    high, broad, fast = F.col("score") >= score, F.col("n_tactics") >= tactics, F.col("hot_score") >= velocity
    severity = F.when((high & broad) | (F.col("score") >= 2 * score), 4).when(high | broad, 3).otherwise(2)
    reasons = F.concat_ws("; ", F.when(high, F.concat(F.lit("score "), F.col("score").cast("string"))), F.when(broad, F.concat(F.lit("tactics "), F.col("n_tactics").cast("string"))), F.when(fast, F.concat(F.lit("velocity "), F.col("hot_score").cast("string"))))
    return rollup.where(high | broad | fast).withColumns({"severity": severity, "reasons": reasons})


def risk_timeline(contributions: DataFrame, entity_type: str, entity: str) -> DataFrame:
    """hour, score, contributions of one entity."""
    own = contributions.where((F.col("entity_type") == entity_type) & (F.col("entity") == entity))
    return own.groupBy(hour_floor(F.col("ts")).alias("hour")).agg(F.sum("risk_score").alias("score"), F.count("*").alias("contributions"))
