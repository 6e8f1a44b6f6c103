"""Rollups, windows and reads that use them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from secspark.operators import govern as G
from secspark.operators import rollups as RU

from .base import T0, T1, Registry, ev, work_dir

R = Registry()

_CAP = """, c AS (
  SELECT ts // 3600 * 3600 AS bucket, source, severity, action, CASE WHEN severity >= 3 THEN src_ip ELSE '' END AS src_ip, host, count(*) AS n, max(ts) AS last_ts FROM ev GROUP BY ALL
), t AS (
  SELECT bucket, src_ip, row_number() OVER (PARTITION BY bucket ORDER BY sum(n) DESC, src_ip) AS r FROM c WHERE src_ip <> '' GROUP BY bucket, src_ip
), k AS (SELECT bucket, src_ip FROM t WHERE r <= 2)
"""
_ROLLUP = "SELECT c.bucket, source, severity, action, CASE WHEN k.src_ip IS NULL THEN '' ELSE c.src_ip END AS src_ip, host, sum(n)::BIGINT AS n, max(last_ts) AS last_ts, 'prod' AS env_id FROM c LEFT JOIN k USING (bucket, src_ip) GROUP BY ALL"


@R.add("r01_event_rollup", _CAP + _ROLLUP)
def _(spark, d):
    return RU.event_rollup(ev(spark, d), min_sev=3, topn=2)


_DIM = """, c AS (
  SELECT ts // 3600 * 3600 AS bucket, source, unnest(CASE WHEN source IN ('error', 'purchase') THEN [{'d': 'host', 'v': host}, {'d': 'src_ip', 'v': CASE WHEN source = 'error' THEN src_ip END}] ELSE [] END) AS x FROM ev
), g AS (SELECT bucket, source, x.d AS dim, x.v AS val, count(*) AS n FROM c WHERE x.v IS NOT NULL GROUP BY ALL
), t AS (SELECT bucket, dim, val, row_number() OVER (PARTITION BY bucket, dim ORDER BY sum(n) DESC, val) AS r FROM g GROUP BY bucket, dim, val
), j AS (SELECT g.*, r FROM g JOIN t USING (bucket, dim, val)
), all_rows AS (
  SELECT bucket, source, dim, val, n, 'prod' AS env_id FROM j WHERE r <= 3
  UNION ALL SELECT bucket, '', '!dim', '', coalesce(sum(n) FILTER (WHERE r > 3), 0)::BIGINT, 'prod' FROM j GROUP BY bucket
)
"""
SPECS = [("error", "host"), ("error", "src_ip"), ("purchase", "host")]


@R.add("r02_dim_rollup", _DIM + "SELECT * FROM all_rows")
def _(spark, d):
    return RU.dim_rollup(ev(spark, d), SPECS, topn=3)


@R.add("r10_cap_report", _DIM + "SELECT sum(n) FILTER (WHERE dim <> '!dim')::BIGINT AS served, sum(n) FILTER (WHERE dim = '!dim')::BIGINT AS dropped, count(DISTINCT bucket) FILTER (WHERE dim <> '!dim') AS hours, count(DISTINCT bucket) FILTER (WHERE dim = '!dim') AS known, CASE WHEN sum(n) FILTER (WHERE dim = '!dim') = 0 THEN 'complete' ELSE 'capped' END AS state FROM all_rows")
def _(spark, d):
    return RU.cap_report(RU.dim_rollup(ev(spark, d), SPECS, topn=3))


@R.add("r03_host_rollup", f"SELECT host, 'prod' AS env_id, max(ts) AS last_ts, min(ts) AS first_ts, count(*) AS sig_total, count(*) FILTER (WHERE ts >= {T0}) AS sig_hot FROM (SELECT host, ts FROM ev UNION ALL SELECT host, ts FROM ev WHERE source = 'purchase' UNION ALL SELECT host, ts FROM ev WHERE source = 'signup') GROUP BY host")
def _(spark, d):
    e = ev(spark, d)
    return RU.host_rollup(e, e.where("source = 'purchase'"), e.where("source = 'signup'"), T0)


@R.add("r03b_merge_host_rollup", f"SELECT host, 'prod' AS env_id, max(ts) AS last_ts, min(ts) AS first_ts, count(*)::BIGINT AS sig_total, count(*) FILTER (WHERE ts >= {T0})::BIGINT AS sig_hot FROM ev GROUP BY host")
def _(spark, d):
    e = ev(spark, d)
    none = e.where("false")
    return RU.merge_host_rollup(RU.host_rollup(e.where(F.col("ts") < T0), none, none, T0), RU.host_rollup(e.where(F.col("ts") >= T0), none, none, T0))


@R.add("r04_banned_ip", "SELECT src_ip, source, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(action, ts) AS label FROM ev WHERE severity >= 2 GROUP BY src_ip, source")
def _(spark, d):
    return RU.banned_ip(ev(spark, d).where("severity >= 2"))


@R.add("r05_metric_rollup", f"SELECT ts // 3600 * 3600 AS bucket, source AS name, '{{}}' AS labels, host, avg(value) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM ev WHERE ts < {T0} GROUP BY ALL")
def _(spark, d):
    m = ev(spark, d).select("ts", F.col("source").alias("name"), F.lit("{}").alias("labels"), "host", "value")
    return RU.metric_rollup(m, T0)[0]


@R.add("r01b_distinct_sketches", f"SELECT source, count(DISTINCT src_ip) AS exact, true AS near FROM ev WHERE ts >= {T0 - 864000} AND ts < {T0 + 864000} GROUP BY source")
def _(spark, d):
    # hourly sketches merged over 20 days, against the exact number: within three standard errors
    e = ev(spark, d)
    lo, hi = T0 - 864000, T0 + 864000
    dc = RU.distinct_from_sketches(RU.sketch_rollup(e, "src_ip", ["source", "host"]), ["source"], lo, hi)
    exact = e.where((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy("source").agg(F.countDistinct("src_ip").alias("exact"))
    return exact.join(dc, "source").select("source", "exact", (F.abs(F.col("dc") - F.col("exact")) <= F.col("exact") * 3 * 1.04 / 2 ** (RU.LG_K / 2)).alias("near"))


@R.add("r07_refresh_rollup", _CAP + _ROLLUP)
def _(spark, d):
    e = ev(spark, d)
    late = (F.col("ts") < T0) & (F.col("id") % 97 == 0)  # rows that came after the rollup was built
    known = e.where((F.col("ts") < T0) & ~late).withColumn("id", F.lit(0).cast("long"))
    new = e.where((F.col("ts") >= T0) | late).withColumn("id", F.lit(1).cast("long"))
    before = RU.event_rollup(known, topn=2)
    return RU.refresh_rollup(before, known.unionByName(new), T0, 0, T0 + 7200, topn=2)


@R.add("r07b_refresh_written", (_CAP + _ROLLUP).replace("FROM ev GROUP BY ALL", "FROM ev WHERE NOT (host = 'h3' AND ts BETWEEN 1704844800 AND 1706745600) GROUP BY ALL"))
def _(spark, d):
    # three rounds on written tables: first rows, late and new rows, and a purge whose hours are rebuilt
    events, rollup, ledger, work = (work_dir(spark, x) for x in ("events", "rollup", "ledger", "purge"))
    e = ev(spark, d).withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema)
    late = (F.col("ts") < T0) & (F.col("id") % 97 == 0)
    known = e.where((F.col("ts") < T0) & ~late).withColumn("id", -F.col("id") - 1)
    for rows in (known, e.where((F.col("ts") >= T0) | late)):
        rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(events)
        RU.refresh_written(spark.read.schema(schema).parquet(events), rollup, ledger, T0, topn=2)
    scope = {"host": "h3", "start": T0, "end": T1}
    plan = G.plan_digest(G.purge_plan(spark.read.schema(schema).parquet(events), scope)).first()
    holds = spark.createDataFrame([], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    _, hours = G.purge_written(spark, events, schema, scope, tuple(plan), holds, work, ["day"])
    RU.refresh_written(spark.read.schema(schema).parquet(events), rollup, ledger, T0, hours, topn=2)
    return RU.read_rollup(spark, rollup)


@R.add("r08_merge_rollup_raw", f"SELECT source, severity, count(*)::BIGINT AS count FROM ev WHERE ts BETWEEN {T0 - 200001} AND {T0 + 5003} GROUP BY source, severity")
def _(spark, d):
    e = ev(spark, d)
    rolled = RU.event_rollup(e.where((F.col("ts") < T0) & (F.col("id") % 5 <= 2)))
    known = F.when((F.col("ts") < T0) & (F.col("id") % 5 <= 2), F.lit(0)).otherwise(F.lit(9)).cast("long")
    return RU.merge_rollup_raw(rolled, e.withColumn("id", known), ["source", "severity"], T0 - 200001, T0 + 5003, T0, 5)


@R.add("r09_dim_counts", f"SELECT host AS val, count(*)::BIGINT AS count FROM ev WHERE source = 'error' AND ts >= {T0} AND ts < {T0 + 360000} AND NOT (ts >= {T0 + 36000} AND ts < {T0 + 72000}) GROUP BY host")
def _(spark, d):
    rolled = RU.dim_rollup(ev(spark, d), [("error", "host")], topn=0)
    return RU.dim_counts(rolled, "error", "host", T0, T0 + 360000, [(T0, T0 + 36000), (T0 + 72000, T0 + 400000)])[0]


@R.add("w03_running_cap", "SELECT id FROM (SELECT id, sum(length(fields)) OVER (ORDER BY ts DESC, id DESC) AS s FROM ev WHERE severity = 3) WHERE s <= 5000")
def _(spark, d):
    from secspark.operators.govern import cap_bytes

    return cap_bytes(ev(spark, d).where("severity = 3").withColumn("env_id", F.lit("prod")), 5000, F.length("fields")).select("id")


@R.add("w04_newest_rows", "SELECT id FROM ev QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) <= 20")
def _(spark, d):
    from secspark.operators.govern import cap_rows

    return cap_rows(ev(spark, d).withColumn("env_id", F.col("source")), 20).select("id")


@R.add("w05_sliding_baseline", """, o AS (SELECT host AS entity, ts // 3600 * 3600 AS bucket, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY ALL),
 s AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM o WINDOW w AS (PARTITION BY entity ORDER BY bucket RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING))
 SELECT entity, bucket, value, n, mean, sd, CASE WHEN n >= 5 AND sd > 0 THEN (value - mean) / sd END AS z FROM s""")
def _(spark, d):
    from secspark.operators.detect import baseline_scores

    return baseline_scores(ev(spark, d), "host", 3600, 604800, 5)


@R.add("w06_latest_sample", "SELECT host, max(id) FILTER (WHERE severity = 3) AS last_failure, count(*) AS n FROM ev GROUP BY host")
def _(spark, d):
    return ev(spark, d).groupBy("host").agg(F.max(F.when(F.col("severity") == 3, F.col("id"))).alias("last_failure"), F.count("*").alias("n"))


@R.add("w07_previous", "SELECT id, lag(action) OVER (PARTITION BY host ORDER BY ts, id) AS prev FROM ev")
def _(spark, d):
    return ev(spark, d).select("id", F.lag("action").over(Window.partitionBy("host").orderBy("ts", "id")).alias("prev"))
