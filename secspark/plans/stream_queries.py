"""Streaming forms over the driver's events: each runs once over what is there and returns the table it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secspark.model import canonical_events
from secspark.operators import ingest as I
from secspark.streaming import stream as T

from .base import T0, Registry, ev, table, work_dir

R = Registry()
_LAST = "(SELECT max(ts) FROM ev)"


def live(spark, d: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, d, "events").schema)
    return T.stream_events(spark, f"{d}/events*.parquet", schema, canonical_events)


def ran(writer, spark) -> None:
    """Run over everything that is there; the state store setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    T.use_rocksdb(spark)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def result(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = work_dir(spark, "stream")
    ran(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").outputMode("append"), spark)
    return spark.read.schema(df.schema).parquet(path)


@R.add("t1_stream_events", "SELECT id, ts, source, host FROM ev")
def _(spark, d):
    return result(live(spark, d)).select("id", "ts", "source", "host")


@R.add("t1b_ingest_chain", f"""
, raw AS (
  SELECT id, ts, host, action, severity, src_ip, source AS kind, CASE source WHEN 'signup' THEN 'ext:secspark-x' ELSE source END AS source,
    CASE WHEN source IN ('error', 'click') THEN src_ip END AS ip, CASE WHEN source = 'error' THEN 'k' || (id % 50) END AS dedup
  FROM ev WHERE source <> 'view'
)
SELECT id, source, CASE WHEN kind = 'error' THEN 'auth' END AS category, CASE WHEN kind = 'error' THEN 'canonical' ELSE 'absent' END AS category_state,
  CASE WHEN kind = 'error' THEN 4 ELSE severity END AS severity, CASE WHEN kind = 'error' THEN host END AS user, CASE WHEN kind = 'click' THEN '[redacted]' ELSE ip END AS src_ip,
  CASE WHEN ip LIKE '10.0.1.%' THEN ip END AS ti_match, CASE WHEN ip IS NOT NULL AND ts < {T0} THEN 'b' END AS engagement_id, CASE WHEN kind = 'purchase' THEN 'lab' ELSE 'prod' END AS env_id, 'v1' AS cim
FROM raw QUALIFY dedup IS NULL OR row_number() OVER (PARTITION BY host, dedup ORDER BY ts, id) = 1
""")
def _(spark, d):
    path, e = work_dir(spark, "ingest"), live(spark, d)
    message = F.when(F.col("source") == "error", F.concat(F.lit("user="), "host", F.lit(' ip="'), "src_ip", F.lit('"'))).when(F.col("source") == "click", F.to_json(F.struct(F.col("src_ip").alias("rhost")))).otherwise(F.col("action"))
    dedup = F.when(F.col("source") == "error", F.concat(F.lit("k"), F.col("id") % 50))
    landed = e.select("id", "ts", F.when(F.col("source") == "signup", "secspark-x").otherwise(F.col("source")).alias("source"), "severity", "host", message.alias("message"), dedup.alias("dedup"))
    bad = ev(spark, d).where(F.col("src_ip").startswith("10.0.1.")).select(F.lit("ip").alias("type"), F.col("src_ip").alias("value"), F.lit("feed").alias("source"), F.lit(90).alias("confidence"), F.lit(3).alias("severity"), F.lit(0).cast("long").alias("expires")).distinct()
    settings = I.Settings(
        regex_parsers=(("error", r"user=(?<user>\S+)"),),
        generic_sources=("click",),
        specs=({"source": "error", "guard": "^user=", "extract": [{"kv": True}], "map": {"category": "auth", "severity": "4", "src_ip": "$ip"}},),
        iocs=bad,
        scopes=spark.createDataFrame([("b", "10.0.", True, 0, T0 - 1)], "id string, matcher string, is_prefix boolean, window_start long, window_end long"),
        version="v1",
        deploys=spark.createDataFrame([("x", "y", T0)], "name string, hash string, deployed_at long"),
        processors=({"field": "source", "op": "eq", "value": "view", "action": "drop"}, {"field": "source", "op": "eq", "value": "click", "action": "mask", "arg": "src_ip"}, {"field": "source", "op": "eq", "value": "purchase", "action": "route", "arg": "lab"}),
    )
    ran(I.ingest_stream(landed, settings, lambda: T0, path, path + "-checkpoint"), spark)
    out = spark.read.parquet(f"{path}/rows")
    member = lambda k: F.get_json_object("fields", f"$.{k}").alias(k)
    return out.select("id", "source", "category", "category_state", "severity", member("user"), "src_ip", "ti_match", "engagement_id", "env_id", member("cim"))


@R.add("t2_hourly_rollup", f"SELECT * FROM (SELECT ts // 3600 * 3600 AS bucket, source, severity, count(*) AS n, max(ts) AS last_ts FROM ev GROUP BY ALL) WHERE bucket + 3600 <= {_LAST} - 7200")
def _(spark, d):
    return result(T.hourly_rollup(live(spark, d), ["source", "severity"]))


@R.add("t3_sliding_rule", f"""SELECT s.w AS start, s.w + 7200 AS "end", host, count(*) AS value FROM (SELECT host, unnest([ts // 3600 * 3600, ts // 3600 * 3600 - 3600]) AS w FROM ev WHERE action = 'failure') s GROUP BY ALL HAVING count(*) > 1 AND s.w + 7200 <= (SELECT max(ts) FROM ev WHERE action = 'failure') - 600""")
def _(spark, d):
    return result(T.sliding_rule(live(spark, d), F.col("action") == "failure", 7200, 3600, 1, ["host"]))


@R.add("t4_split_late", f"SELECT id, ts < {T0} AND ts < (SELECT max(ts) FROM ev) - 86400 AS late FROM ev")
def _(spark, d):
    # two landed files: the second one has the older rows
    landed, path = work_dir(spark, "landed"), work_dir(spark, "split")
    e = ev(spark, d).select("id", "ts")
    schema = "id long, ts long"
    for part in (F.col("ts") >= T0, F.col("ts") < T0):
        e.where(part).coalesce(1).write.mode("append").parquet(landed)
        ran(T.split_late_stream(spark.readStream.schema(schema).parquet(landed), 86400, path, path + "-checkpoint"), spark)
    return reduce(DataFrame.unionByName, [T.late_rows(spark, path, schema, late).select("id", F.lit(late).alias("late")) for late in (False, True)])


@R.add("t5_dedup_stream", "SELECT DISTINCT host, json_extract_string(fields, '$.k') AS dedup FROM ev WHERE id % 7 <> 0 UNION ALL SELECT host, NULL FROM ev WHERE id % 7 = 0")
def _(spark, d):
    keyed = live(spark, d).withColumn("dedup", F.when(F.col("id") % 7 != 0, F.get_json_object("fields", "$.k")))
    return result(T.dedup_stream(keyed, "400 days").select("host", "dedup"))


_HITS = """
, hit AS (
  SELECT src_ip AS key, ts, 0 AS step FROM ev WHERE action = 'failure' UNION ALL SELECT src_ip, ts, 1 FROM ev WHERE source = 'signup' UNION ALL SELECT src_ip, ts, 2 FROM ev WHERE source = 'purchase'
), closed AS (SELECT * FROM hit WHERE ts <= (SELECT max(ts) FROM hit) - 600
), a AS (SELECT key, ts AS s, min(nth) AS t FROM (SELECT key, ts, lead(ts, 2) OVER (PARTITION BY key ORDER BY ts) AS nth FROM closed WHERE step = 0) WHERE nth IS NOT NULL GROUP BY key, ts
), b AS (SELECT a.key, s, h.ts AS t FROM a JOIN closed h ON h.key = a.key AND h.ts >= a.t WHERE step = 1 QUALIFY row_number() OVER (PARTITION BY a.key, s ORDER BY h.ts) = 2
), c AS (SELECT b.key, s, h.ts AS t FROM b JOIN closed h ON h.key = b.key AND h.ts >= b.t WHERE step = 2 QUALIFY row_number() OVER (PARTITION BY b.key, s ORDER BY h.ts) = 1)
"""


@R.add("t6_correlate_stream", _HITS + "SELECT DISTINCT key, t AS completed FROM c WHERE t <= s + 864000")
def _(spark, d):
    steps = [(F.col("action") == "failure", 3), (F.col("source") == "signup", 2), (F.col("source") == "purchase", 1)]
    return result(T.correlate_stream(live(spark, d), steps, "src_ip", 864000))


@R.add("t6b_snapshot_changes", f", s AS (SELECT DISTINCT host, ts, action AS hash FROM ev WHERE ts <= {_LAST} - 600) SELECT 'state' AS kind, host, ts, hash FROM s QUALIFY coalesce(lag(hash) OVER (PARTITION BY host ORDER BY ts, hash) <> hash, true)")
def _(spark, d):
    return result(T.snapshot_changes(live(spark, d).select(F.lit("state").alias("kind"), "host", "ts", F.col("action").alias("hash"))))


@R.add("t6c_throttle_stream", f", r AS (SELECT host AS key, min(ts) AS ts FROM ev GROUP BY host) SELECT key, ts FROM r WHERE ts <= {_LAST} - 600")
def _(spark, d):
    return result(T.throttle_stream(live(spark, d).select(F.col("host").alias("key"), "ts"), 400 * 86400))


@R.add("t7_match_iocs_stream", "SELECT id, CASE WHEN src_ip LIKE '10.0.1.%' THEN src_ip END AS ti_match, src_ip LIKE '10.0.1.%' AS threat_intel FROM ev")
def _(spark, d):
    path = work_dir(spark, "iocs")

    def iocs():
        e = ev(spark, d).where(F.col("src_ip").startswith("10.0.1."))
        return e.select(F.lit("ip").alias("type"), F.col("src_ip").alias("value"), F.lit("feed").alias("source"), F.lit(90).alias("confidence"), F.lit(3).alias("severity"), F.lit(0).cast("long").alias("expires")).distinct()

    ran(T.match_iocs_stream(live(spark, d), iocs, lambda: T0, lambda df, n: df.select("id", "ti_match", "threat_intel").write.mode("append").parquet(path), path + "-checkpoint"), spark)
    return spark.read.parquet(path)


@R.add("t7b_enrich_stream", "SELECT id, host, n FROM ev LEFT JOIN (SELECT host, count(*) AS n FROM ev WHERE severity = 3 GROUP BY host) USING (host)")
def _(spark, d):
    lookup = ev(spark, d).where("severity = 3").groupBy("host").agg(F.count("*").alias("n"))
    return result(T.enrich_stream(live(spark, d).select("id", "host"), lookup, "host"))


@R.add("t8_closed_buckets", f"SELECT * FROM (SELECT host AS entity, ts // 21600 * 21600 AS bucket, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY ALL) WHERE bucket + 21600 <= {_LAST} - 600")
def _(spark, d):
    return result(T.closed_buckets(live(spark, d), "host", "6 hours"))


@R.add("t8b_stream_baseline", f""", o AS (
  SELECT * FROM (SELECT host AS entity, ts // 21600 * 21600 AS bucket, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY ALL) WHERE bucket + 21600 <= {_LAST} - 600
)
SELECT entity, bucket, value, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd,
  CASE WHEN count(value) OVER w >= 5 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z
FROM o WINDOW w AS (PARTITION BY entity ORDER BY bucket RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    return result(T.baseline_stream(live(spark, d), "host", 21600, 604800, 5))


@R.add("t9_forward_stream", "SELECT id, '<' || CASE severity WHEN 3 THEN 11 ELSE 12 END || '>1 ' || strftime(to_timestamp(ts), '%Y-%m-%dT%H:%M:%SZ') || ' ' || host || ' ' || source || ' - - - ' || action AS body FROM ev WHERE severity >= 2")
def _(spark, d):
    path = work_dir(spark, "forward")
    rows = live(spark, d).withColumn("message", F.col("action"))
    ran(T.forward_stream(rows, F.col("severity") >= 2, "rfc5424", lambda df, n: df.write.mode("append").parquet(path), path + "-checkpoint"), spark)
    return spark.read.parquet(path)
