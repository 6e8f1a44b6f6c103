"""The event model: schemas, closed vocabularies, and the adapter for the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns and types of the stored tables.
EVENT = "id long, ts long, source string, category string, severity int, host string, message string, src_ip string, dst_ip string, url string, xff string, fields string, dedup string, env_id string, origin string, engagement_id string"
METRIC = "ts long, name string, labels string, value double, host string, env_id string"
SNAPSHOT = "id long, ts long, kind string, hash string, data string, host string, env_id string"
ALERT = "id long, ts long, rule string, severity int, title string, detail string, status string, dedup string, mitre string, host string, src_ip string, sources string, env_id string, engagement_id string"
IOC = "type string, value string, source string, confidence int, severity int, first_seen long, last_seen long, expires long, stix_id string, env_id string"
RISK_EVENT = "id long, ts long, entity_type string, entity string, risk_score int, source string, rule_id long, reason string, mitre string, severity int, env_id string, dedup string"

# Severity by name.
SEVERITY_NAMES = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
DEFAULT_ENV = "prod"
#: First part of source names that only the system itself may write.
RESERVED_SOURCE = "secspark-"


def field(key: str, column: str = "fields"):
    """A value of the JSON bag as text; null if absent."""
    return F.get_json_object(F.col(column), f"$['{key}']")


def canonical_events(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The driver's events in the event model; lazy projections only.

    The model's ts is an expression, which a scan can't filter by. ``start`` and ``end`` (seconds, both included) bound
    the stored timestamp itself, so that row groups outside are skipped.
    """
    at = lambda s: F.timestamp_seconds(F.lit(s)).cast(df.schema["ts"].dataType)
    if start is not None:
        df = df.where(F.col("ts") >= at(start))
    if end is not None:
        df = df.where(F.col("ts") < at(end + 1))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind, user = F.col("event_type"), F.col("user_id")
    return df.select(
        F.col("event_id").alias("id"),
        F.floor(micros / 1_000_000).alias("ts"),
        kind.alias("source"),
        F.when(kind == "error", 3).when(kind == "purchase", 2).when(kind == "signup", 1).otherwise(0).alias("severity"),
        F.when(kind == "error", "failure").when(kind == "purchase", "modify").when(kind == "signup", "success").otherwise("read").alias("action"),
        F.concat(F.lit("h"), (user % 20).cast("string")).alias("host"),
        F.concat(F.lit("10.0."), (user % 8).cast("string"), F.lit("."), (user % 250 + 1).cast("string")).alias("src_ip"),
        F.col("props").alias("fields"),
        F.col("value"),
    )
