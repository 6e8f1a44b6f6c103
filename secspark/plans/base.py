"""What named queries share: reading a table, the event view in SQL, and a registering decorator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from secspark.model import canonical_events

#: The canonical events as a common table expression; every SQL text starts with it.
EV = """
WITH ev AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, event_type AS source,
    CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS INTEGER) AS severity,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'modify' WHEN 'signup' THEN 'success' ELSE 'read' END AS action,
    'h' || (user_id % 20) AS host, '10.0.' || (user_id % 8) || '.' || (user_id % 250 + 1) AS src_ip,
    props AS fields, value
  FROM events
)
"""
#: Fixed instants inside the driver's events (UTC): 10 January 2024, and the end of the month.
T0, T1 = 1704844800, 1706745600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return canonical_events(table(spark, sf_dir, "events"), start, end)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plans-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, events: bool = True):
        """Register a query; ``sql`` goes on from the event view (or stands alone)."""

        def wrap(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = (EV + sql) if events else sql
            return f

        return wrap
