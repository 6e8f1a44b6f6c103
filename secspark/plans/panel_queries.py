"""Panels, governance and semantic-layer queries. Alerts, cases and feeds are derived from the driver's events by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.operators import govern as G
from secspark.operators import panels as N
from secspark.operators import rollups as RU
from secspark.operators import semantic as M
from secspark.operators import sigma as S
from secspark.operators.search import Search

from .base import T0, T1, Registry, ev, work_dir

R = Registry()
AL = """, al AS (SELECT id, ts, source AS rule, severity, 'event ' || id AS title, CASE WHEN id % 3 = 0 THEN 'closed' WHEN id % 3 = 1 THEN 'new' ELSE 'ack' END AS status,
 CASE severity WHEN 3 THEN 'T1110.001, T1078' WHEN 2 THEN 'T1098' ELSE '' END AS mitre, CASE WHEN id % 10 = 0 THEN NULL ELSE host END AS host, src_ip, source || chr(10) || 'x' AS sources FROM ev WHERE severity > 0)
"""
CA = f""", ca AS (SELECT id, ts, 1 + id % 4 AS priority, host AS assignee, CASE WHEN id % 3 = 0 THEN 'closed' WHEN id % 7 = 0 THEN 'waiting' ELSE 'open' END AS status,
 CASE WHEN id % 5 <> 0 THEN ts + id % 1000 END AS first_response_ts, CASE WHEN id % 3 = 0 THEN ts + 3000 + id % 5000 END AS closed_ts, ts + 90000 AS resolve_due, CASE WHEN id % 2 = 0 THEN 60 END AS sla_pause_accum,
 id % 11 = 0 AS ack_breached, id % 13 = 0 AS resolve_breached, id % 17 = 0 AS archived FROM ev WHERE source = 'purchase')
"""


def alerts(spark, d):
    c = F.col
    return ev(spark, d).where("severity > 0").select(
        "id", "ts", c("source").alias("rule"), "severity", F.concat(F.lit("event "), "id").alias("title"), F.when(c("id") % 3 == 0, "closed").when(c("id") % 3 == 1, "new").otherwise("ack").alias("status"),
        F.when(c("severity") == 3, "T1110.001, T1078").when(c("severity") == 2, "T1098").otherwise("").alias("mitre"), F.when(c("id") % 10 != 0, c("host")).alias("host"), "src_ip", F.concat("source", F.lit("\nx")).alias("sources"),
    )


def cases(spark, d):
    i, ts = F.col("id"), F.col("ts")
    return ev(spark, d).where("source = 'purchase'").select(
        "id", "ts", (1 + i % 4).cast("int").alias("priority"), F.col("host").alias("assignee"), F.when(i % 3 == 0, "closed").when(i % 7 == 0, "waiting").otherwise("open").alias("status"), F.when(i % 5 != 0, ts + i % 1000).alias("first_response_ts"),
        F.when(i % 3 == 0, ts + 3000 + i % 5000).alias("closed_ts"), (ts + 90000).alias("resolve_due"), F.when(i % 2 == 0, F.lit(60)).alias("sla_pause_accum"), F.lit(None).cast("long").alias("sla_paused_since"),
        (i % 11 == 0).alias("ack_breached"), (i % 13 == 0).alias("resolve_breached"), (i % 17 == 0).alias("archived"), F.lit(None).cast("long").alias("merged_into"),
    )


def metrics(spark, d):
    return ev(spark, d).select("ts", F.col("source").alias("name"), F.to_json(F.struct("host", "action")).alias("labels"), "value", "host")


@R.add("p01_alert_groups", AL + "SELECT coalesce(host, '') AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(severity) AS max_severity, count(*) FILTER (WHERE status <> 'closed') AS open, arg_max(title, ts) AS title, arg_max(id, ts) AS last_id FROM al GROUP BY 1")
def _(spark, d):
    return N.alert_groups(alerts(spark, d), "host")


@R.add("p02_filter_alerts", AL + "SELECT id FROM al WHERE status = 'new' AND severity = 3 AND id % 5 <> 0")
def _(spark, d):
    a = alerts(spark, d)
    return N.filter_alerts(a, "new", "T1110", "error", a.where("id % 5 = 0").select(F.concat(F.lit("alert:"), "id").alias("ref"))).select("id")


@R.add("p03_technique_detections", AL + f"SELECT t AS technique, count(*) AS n, min(ts) AS first_ts FROM (SELECT ts, unnest(string_split(mitre, ', ')) AS t FROM al WHERE mitre <> '') WHERE ts >= {T0} GROUP BY t")
def _(spark, d):
    return N.technique_detections(alerts(spark, d), T0)


@R.add("p04_attack_matrix", AL + """, r AS (SELECT t AS technique, count(*) AS alerts FROM (SELECT unnest(CASE severity WHEN 3 THEN ['T1110', 'T1078'] ELSE ['T1098'] END) AS t FROM al WHERE severity >= 2) GROUP BY t),
 c(tactic, technique) AS (VALUES ('credential-access', 'T1110'), ('discovery', 'T1046')), u(technique, rules) AS (VALUES ('T1110', 1), ('T1046', 1))
 SELECT coalesce(tactic, 'unmapped') AS tactic, technique, coalesce(rules, 0) AS rules, coalesce(alerts, 0) AS alerts, coalesce(rules, 0) > 0 AS covered FROM r FULL JOIN c USING (technique) LEFT JOIN u USING (technique)""")
def _(spark, d):
    rules = spark.createDataFrame([("T1110.001", True), ("T1046", True), ("T1098", False)], "mitre string, enabled boolean")
    catalog = spark.createDataFrame([("credential-access", "T1110"), ("discovery", "T1046")], "tactic string, technique string")
    return N.attack_matrix(rules, alerts(spark, d), catalog)


@R.add("p05_scoped_detections", AL + f"SELECT t AS technique, count(*) AS n, min(ts) AS first_ts FROM (SELECT ts, unnest(string_split(mitre, ', ')) AS t FROM al WHERE mitre <> '' AND src_ip LIKE '10.0.1.%' AND ts BETWEEN {T0} AND {T1}) GROUP BY t")
def _(spark, d):
    e = ev(spark, d).withColumn("engagement_id", F.when(F.col("src_ip").startswith("10.0.1."), "e1"))
    return N.scoped_detections(alerts(spark, d), e, "e1", T0, T1)


@R.add("p06_compliance_posture", "SELECT x.f AS framework, x.c AS control, count(*) FILTER (WHERE action = 'success') AS passed, count(*) FILTER (WHERE action = 'failure') AS failed, count(*) FILTER (WHERE action NOT IN ('success', 'failure')) AS na FROM (SELECT action, unnest(CASE WHEN id % 2 = 0 THEN [{'f': 'cis', 'c': host}, {'f': 'pci', 'c': '1.1'}] ELSE [{'f': 'nist', 'c': ''}] END) AS x FROM ev) GROUP BY ALL")
def _(spark, d):
    return N.compliance_posture(_checks(spark, d))


def _checks(spark, d):
    return ev(spark, d).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("cis:"), "host", F.lit("; pci:1.1"))).alias("posture_compliance"), F.lit("nist").alias("posture_framework"), F.when(F.col("action") == "success", "passed").when(F.col("action") == "failure", "failed").otherwise("n/a").alias("posture_result"))


@R.add("p07_compliance_coverage", "SELECT framework, control, coalesce(rules, 0) AS rules, coalesce(failed, 0) AS failed, CASE WHEN rules > 0 AND failed > 0 THEN 'both' WHEN rules > 0 THEN 'monitored' WHEN failed > 0 THEN 'finding' ELSE 'none' END AS state FROM (SELECT 'cis' AS framework, host AS control, count(*) FILTER (WHERE action = 'failure') AS failed FROM ev WHERE id % 2 = 0 GROUP BY host UNION ALL SELECT 'pci', '1.1', count(*) FILTER (WHERE action = 'failure') FROM ev WHERE id % 2 = 0 UNION ALL SELECT 'nist', '', count(*) FILTER (WHERE action = 'failure') FROM ev WHERE id % 2 = 1) FULL JOIN (VALUES ('cis', 'h3', 1), ('iso', 'A.5', 1)) r(framework, control, rules) USING (framework, control)")
def _(spark, d):
    rules = spark.createDataFrame([("cis:h3, iso:A.5", True), ("pci:1.1", False)], "compliance string, enabled boolean")
    return N.compliance_coverage(rules, N.compliance_posture(_checks(spark, d)))


_STATUS = "CASE WHEN n_24h = 0 THEN CASE WHEN age > 5 * interval_s THEN 'muted' ELSE 'calm' END WHEN age > 5 * interval_s THEN 'muted' WHEN age > 2 * interval_s THEN 'late' ELSE 'fresh' END"


@R.add("p08_freshness", f""", e AS (SELECT source AS feed, 'event' AS kind, max(ts) AS last_ts, count(*) FILTER (WHERE ts > {T1 - 86400}) AS n_24h, (max(ts) - min(ts)) / greatest(count(*) - 1, 1) AS o FROM ev GROUP BY source),
 m AS (SELECT 'm_' || source AS feed, 'metric' AS kind, max(ts) AS last_ts, count(*) FILTER (WHERE ts > {T1 - 86400}) AS n_24h, (max(ts) - min(ts)) / greatest(count(*) - 1, 1) AS o FROM ev GROUP BY source),
 h AS (SELECT action, host, max(ts) AS l, count(*) FILTER (WHERE ts > {T1 - 86400}) AS n, min(ts) AS f, count(*) AS a FROM ev GROUP BY action, host),
 s AS (SELECT action AS feed, 'snapshot' AS kind, min(l) AS last_ts, sum(n)::BIGINT AS n_24h, (max(l) - min(f)) / greatest(max(a) - 1, 1) AS o FROM h GROUP BY action),
 j AS (SELECT feed, kind, last_ts, n_24h, CASE feed WHEN 'error' THEN 20.0 ELSE o END AS interval_s, {T1} - last_ts AS age FROM (SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT * FROM s))
 SELECT *, {_STATUS} AS status FROM j""")
def _(spark, d):
    e = ev(spark, d)
    cadence = spark.createDataFrame([("error", 20)], "feed string, interval_s int")
    return N.freshness(e, e.select(F.col("action").alias("kind"), "host", "ts"), e.select(F.concat(F.lit("m_"), "source").alias("name"), "ts"), cadence, T1)


@R.add("p09_heartbeats", f", f AS (SELECT source, max(ts) AS l FROM ev GROUP BY source) SELECT 's_' || source AS sensor, CASE WHEN {T1} - l <= 5000 THEN 'active' ELSE 'muted' END AS state, l AS last_ts FROM f UNION ALL SELECT 'gone', 'unknown', NULL")
def _(spark, d):
    feeds = ev(spark, d).groupBy(F.col("source").alias("feed")).agg(F.max("ts").alias("last_ts"))
    sensors = feeds.select(F.concat(F.lit("s_"), "feed").alias("sensor"), "feed", F.lit(1000).alias("interval_s"), F.lit(False).alias("event_driven"), F.lit(None).cast("string").alias("pipeline"))
    gone = spark.createDataFrame([("gone", "none", 1000, True, None)], sensors.schema)
    return N.heartbeats(feeds, sensors.union(gone), T1)


@R.add("p10_fleet", f"SELECT host, max(ts) AS last_ts, {T1} - max(ts) AS age, CASE WHEN {T1} - max(ts) <= 900 THEN 'fresh' WHEN {T1} - max(ts) <= 3600 THEN 'stale' ELSE 'silent' END AS state, host IN ('h1', 'h2') AS enrolled, count(*)::BIGINT AS signals FROM ev GROUP BY host UNION ALL SELECT 'new', NULL, NULL, 'silent', true, 0")
def _(spark, d):
    return N.fleet(_hosts(spark, d), spark.createDataFrame([("h1",), ("h2",), ("new",)], "host string"), T1)


def _hosts(spark, d):
    e = ev(spark, d)
    return RU.host_rollup(e, e.where("false"), e.where("false"), T0)


@R.add("p11_silent_fleet", f", h AS (SELECT host, max(ts) AS l FROM ev GROUP BY host) SELECT count(*) AS expected, count(*) FILTER (WHERE {T1} - l > 3600) AS silent, list_slice(list(host ORDER BY l, host) FILTER (WHERE {T1} - l > 3600), 1, 5) AS worst FROM h")
def _(spark, d):
    return N.silent_fleet(_hosts(spark, d), T1).drop("fingerprint")


@R.add("p12_unmitigated", "SELECT src_ip, count(*) AS hits FROM ev WHERE source IN ('error', 'purchase') GROUP BY src_ip HAVING count(*) > 20 AND src_ip NOT LIKE '10.0.1.%'")
def _(spark, d):
    e = ev(spark, d)
    return N.unmitigated(e, e.where(F.col("src_ip").startswith("10.0.1.")).select("src_ip"), ["error", "purchase"])


@R.add("p12b_ban_coverage", ", a AS (SELECT src_ip FROM ev WHERE source IN ('error', 'purchase') GROUP BY src_ip HAVING count(*) > 20) SELECT count(*) AS attackers, count(*) FILTER (WHERE src_ip LIKE '10.0.1.%') AS banned, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE src_ip LIKE '10.0.1.%') * 100.0 / count(*), 1) END AS percent FROM a")
def _(spark, d):
    e = ev(spark, d)
    return N.ban_coverage(e, e.where(F.col("src_ip").startswith("10.0.1.")).select("src_ip"), ["error", "purchase"])


@R.add("p13_overview", AL + CA + f"SELECT (SELECT count(*) FROM ev WHERE ts > {T1 - 86400 * 3}) AS events_24h, (SELECT count(DISTINCT host) FROM ev WHERE ts > {T1 - 86400 * 3}) AS hosts_24h, (SELECT count(*) FROM al WHERE status <> 'closed') AS open_alerts, (SELECT count(*) FROM al WHERE status <> 'closed' AND severity >= 3) AS open_high, (SELECT count(*) FROM ca WHERE status <> 'closed') AS open_cases")
def _(spark, d):
    return N.overview(ev(spark, d), alerts(spark, d), cases(spark, d), T1 - 86400 * 2)


@R.add("p13b_environments", "SELECT CASE WHEN id % 4 = 0 THEN 'lab' ELSE 'prod' END AS env_id, count(*) AS n, max(ts) AS last_ts FROM ev GROUP BY 1")
def _(spark, d):
    return N.environments(ev(spark, d).withColumn("env_id", F.when(F.col("id") % 4 == 0, "lab")))


@R.add("p14_case_queues", CA + f"SELECT assignee, count(*) AS open, count(*) FILTER (WHERE resolve_due < {T0}) AS overdue, count(*) FILTER (WHERE first_response_ts IS NULL) AS ack_pending, count(*) FILTER (WHERE ack_breached OR resolve_breached) AS breached, count(*) FILTER (WHERE status = 'waiting') AS waiting FROM ca WHERE NOT archived AND status <> 'closed' GROUP BY assignee")
def _(spark, d):
    return N.case_queues(cases(spark, d), T0)


_M = "count(*) AS cases, avg(a) AS mtta_mean, list_sort(list(a) FILTER (WHERE a IS NOT NULL))[1 + count(a) // 2] AS mtta_p50, avg(r) AS mttr_mean, list_sort(list(r) FILTER (WHERE r IS NOT NULL))[1 + count(r) // 2] AS mttr_p50, count(*) FILTER (WHERE ack_breached OR resolve_breached) AS breaches"


@R.add("p15_case_metrics", CA + f", m AS (SELECT *, first_response_ts - ts AS a, closed_ts - ts - coalesce(sla_pause_accum, 0) AS r FROM ca WHERE ts BETWEEN {T0} AND {T1}) SELECT assignee, {_M} FROM m GROUP BY assignee UNION ALL SELECT NULL, {_M} FROM m")
def _(spark, d):
    return N.case_metrics(cases(spark, d), T0, T1)


@R.add("p16_sla", CA + ", k AS (SELECT id, ts + CASE priority WHEN 1 THEN 600 WHEN 2 THEN 3600 WHEN 3 THEN 14400 ELSE 28800 END + coalesce(sla_pause_accum, 0) AS ack_due, ts + CASE priority WHEN 1 THEN 1200 WHEN 2 THEN 28800 WHEN 3 THEN 86400 ELSE 259200 END + coalesce(sla_pause_accum, 0) AS resolve_due, first_response_ts, closed_ts FROM ca) " + f"SELECT id, 'ack' AS breach FROM k WHERE coalesce(first_response_ts, {T0}) > ack_due UNION ALL SELECT id, 'resolve' FROM k WHERE coalesce(closed_ts, {T0}) > resolve_due")
def _(spark, d):
    policies = spark.createDataFrame([(1, 600, 1200)], "priority int, ack_s int, resolve_s int")
    return N.sla_breaches(N.sla_deadlines(cases(spark, d), policies), T0)


_L = "'{\"host\":\"' || host || '\",\"action\":\"' || action || '\"}'"


@R.add("p17_prom_instant", f"SELECT source AS name, {_L} AS labels, host, arg_max(value, ts) AS value, max(ts) AS ts FROM ev WHERE source = 'click' AND action = 'read' AND ts > {T0 - 86400} AND ts <= {T0} GROUP BY source, host, action")
def _(spark, d):
    return N.prom_instant(metrics(spark, d), "click", {"action": "read"}, T0, 86400)


@R.add("p17b_prom_range", f"SELECT source AS name, {_L} AS labels, host, ts, value FROM ev WHERE source = 'click' AND host = 'h4' AND ts BETWEEN {T0} AND {T0 + 86400}")
def _(spark, d):
    return N.prom_range(metrics(spark, d), "click", {"host": "h4"}, T0, T0 + 86400)


@R.add("p17c_label_values", "SELECT DISTINCT host AS value FROM ev")
def _(spark, d):
    return N.label_values(metrics(spark, d), "host")


@R.add("p17d_labels_series", f"SELECT DISTINCT source AS name, {_L} AS labels, host FROM ev WHERE action = 'failure'")
def _(spark, d):
    return N.series(metrics(spark, d), None, {"action": "failure"})


@R.add("p18_source_inventory", f", s AS (SELECT source, max(ts) AS last_ts, count(*) FILTER (WHERE ts > {T1 - 86400}) AS n_24h, (max(ts) - min(ts)) / greatest(count(*) - 1, 1) AS interval_s, {T1} - max(ts) AS age FROM ev WHERE ts > {T1 - 604800} GROUP BY source HAVING count(*) >= 3) SELECT source, source = 'error' AS expected, last_ts, n_24h, {_STATUS} AS status FROM s UNION ALL SELECT 'never', true, NULL, 0, 'dormant'")
def _(spark, d):
    return N.source_inventory(ev(spark, d), spark.createDataFrame([("error",), ("never",)], "source string"), T1)


@R.add("p19_ioc_coverage", f", i AS (SELECT CASE WHEN id % 2 = 0 THEN 'ip' ELSE 'url' END AS type, source, CASE WHEN id % 3 <> 0 THEN ts END AS expires FROM ev) SELECT type, source, count(*) AS total, count(*) FILTER (WHERE expires IS NULL OR expires > {T0}) AS active, count(*) FILTER (WHERE expires <= {T0}) AS expired FROM i GROUP BY GROUPING SETS ((type), (source), ())")
def _(spark, d):
    i = ev(spark, d).select(F.when(F.col("id") % 2 == 0, "ip").otherwise("url").alias("type"), "source", F.when(F.col("id") % 3 != 0, F.col("ts")).alias("expires"))
    return N.ioc_coverage(i, T0)


@R.add("p20_report_rows", "SELECT count(*) AS rows FROM ev WHERE severity = 3")
def _(spark, d):
    return N.report_rows(Search(ev(spark, d)).search(F.col("severity") == 3), {"src_ip": "hash"})[0]


@R.add("p20b_report_first_rows", "SELECT id, ts, substr(sha256('salt' || chr(0) || src_ip), 1, 16) AS src_ip, host FROM ev WHERE severity = 3 ORDER BY ts DESC, id DESC LIMIT 20")
def _(spark, d):
    return N.report_rows(Search(ev(spark, d)).search(F.col("severity") == 3), {"src_ip": "hash"}, "salt")[1].select("id", "ts", "src_ip", "host")


@R.add("p20c_report_aggregate", "SELECT who, count(*) AS count, list_sort(list(DISTINCT '***')) AS values, max(ts) AS max FROM (SELECT substr(sha256('salt' || chr(0) || src_ip), 1, 16) AS who, ts FROM ev WHERE severity >= 1) GROUP BY who ORDER BY count DESC, who LIMIT 20")
def _(spark, d):
    s = Search(ev(spark, d)).search(F.col("severity") >= 1).rename(who="src_ip").stats("count", ("values", "host"), ("max", "ts"), by=["who"]).sort("-count", "who").head(20)
    return N.report_rows(s, {"src_ip": "hash", "host": "mask"}, "salt")[1]


# governance
@R.add("g01_masks", "SELECT substr(sha256('salt' || chr(0) || src_ip), 1, 16) AS src_ip, '***' AS host, count(*) AS count FROM ev GROUP BY ev.src_ip")
def _(spark, d):
    masks = G.resolve_masks([{"field": "src_ip", "mask": "hash"}, {"field": "host", "mask": "mask", "role": "analyst"}, {"field": "host", "mask": "clear"}], "analyst", "t", "prod", {"analyst"})
    return Search(G.apply_masks(ev(spark, d), masks, "salt")).stats("count", by=["src_ip", "host"]).df


@R.add("g03_retain", f"SELECT id FROM ev WHERE NOT (ts < {T1} - CASE WHEN id % 4 = 0 THEN 7 ELSE 14 END * 86400 AND source <> 'signup') OR (source = 'error' AND ts >= {T0})")
def _(spark, d):
    holds = spark.createDataFrame([("error", T0, None, True), ("click", None, None, False)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    e = ev(spark, d).withColumn("env_id", F.when(F.col("id") % 4 == 0, "lab").otherwise("prod"))
    return G.retain(e, {"lab": 2}, 14, holds, T1, ["signup"]).select("id")


@R.add("g05_legal_hold", f"SELECT id FROM ev WHERE NOT (source = 'error' AND ts >= {T0}) AND NOT (ts BETWEEN {T0 - 3600} AND {T0})")
def _(spark, d):
    holds = spark.createDataFrame([("error", T0, None, True), (None, T0 - 3600, T0, True)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    return G.legal_hold_filter(ev(spark, d), holds).select("id")


@R.add("g06_purge_plan", f"SELECT source, count(*) AS n, min(id) AS min_id, max(id) AS max_id, min(ts) AS min_ts, max(ts) AS max_ts, list_slice(list_sort(coalesce(list(id) FILTER (WHERE id % 97 = 0), [])), 1, 5) AS samples FROM ev WHERE host = 'h3' AND ts BETWEEN {T0} AND {T1} GROUP BY source")
def _(spark, d):
    from pyspark.sql import Window

    # the SQL's samples are the first multiples of 97 of a source, not the plan's oldest and newest rows
    e = ev(spark, d)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    few = e.where((F.col("host") == "h3") & F.col("ts").between(T0, T1) & (F.col("id") % 97 == 0)).withColumn("r", rank).where("r <= 5")
    few = few.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list("id")).alias("samples"))
    plan = G.purge_plan(e, {"host": "h3", "start": T0, "end": T1}).drop("digest", "samples")
    return plan.join(few, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("samples", F.coalesce("samples", F.array().cast("array<long>")))


def _stored(spark, d: str) -> tuple[str, str]:
    """The events as a table with one folder a day, and its schema."""
    path = work_dir(spark, "events")
    e = ev(spark, d).withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    e.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    return path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema)


@R.add("g06b_purge_apply", f"SELECT id, ts, source, host, fields FROM ev WHERE NOT (host = 'h3' AND ts BETWEEN {T0} AND {T1}) OR source = 'error' OR ts BETWEEN {T0 + 86400} AND {T0 + 172800}")
def _(spark, d):
    path, schema = _stored(spark, d)
    scope = {"host": "h3", "start": T0, "end": T1}
    plan = G.plan_digest(G.purge_plan(spark.read.schema(schema).parquet(path), scope)).first()
    holds = spark.createDataFrame([("error", None, None, True), (None, T0 + 86400, T0 + 172800, True), ("click", None, None, False)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    G.purge_written(spark, path, schema, scope, tuple(plan), holds, work_dir(spark, "purge"), ["day"])
    return spark.read.schema(schema).parquet(path).select("id", "ts", "source", "host", "fields")


@R.add("g03b_retain_written", f"SELECT id, ts, source FROM ev WHERE NOT (ts < {T1} - 14 * 86400 AND source <> 'signup') OR (source = 'error' AND ts >= {T0})")
def _(spark, d):
    path, schema = _stored(spark, d)
    holds = spark.createDataFrame([("error", T0, None, True)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    G.retain_written(spark, path, schema, {}, 14, holds, T1, ["signup"], work_dir(spark, "retain"), ["day"])
    return spark.read.schema(schema).parquet(path).select("id", "ts", "source")


@R.add("g08_verify_chain", "SELECT CAST(42 AS BIGINT) AS first_broken FROM ev LIMIT 1")
def _(spark, d):
    from pyspark.sql import Window

    # links of neighbours only: each row's stored hash depends on the row before it by position, not by chain
    e = ev(spark, d).select(F.col("id"), "ts", F.col("source").alias("kind"), F.col("fields").alias("detail"), (F.floor(F.col("id") / 2)).alias("pair"))
    head = e.where("id % 2 = 0").withColumn("prev_hash", F.lit(""))
    head = head.withColumn("hash", G.chain_hash(F.col("prev_hash")))
    tail = e.where("id % 2 = 1").join(head.select("pair", F.col("hash").alias("prev_hash")), "pair")
    tail = tail.withColumn("hash", G.chain_hash(F.col("prev_hash")))
    both = head.select(*tail.columns).unionByName(tail)
    broken = both.withColumn("detail", F.when(F.col("id") == 42, "changed").otherwise(F.col("detail")))
    return G.verify_chain(broken, "pair").agg(F.min("first_broken").alias("first_broken"))


@R.add("g09_index_stats", "SELECT 'prod' AS env_id, count(*)::BIGINT AS n, min(ts // 3600 * 3600) AS oldest, max(ts) AS last_ts FROM ev")
def _(spark, d):
    return G.index_stats(RU.event_rollup(ev(spark, d)))


# semantic layer
@R.add("m01_alias_calculated", "SELECT id, host AS machine, value * 2 AS double_value, value * 2 > 100 AS big FROM ev")
def _(spark, d):
    e = M.field_alias(ev(spark, d), {"machine": "host"})
    return M.calculated_fields(e, [("double_value", lambda: F.col("value") * 2), ("big", lambda: F.col("double_value") > 100)]).select("id", "machine", "double_value", "big")


@R.add("m03_types_tags", "SELECT list_filter([CASE WHEN action = 'failure' THEN 'failed' END, CASE WHEN value > 100 THEN 'large' END], lambda x: x IS NOT NULL) AS event_types, source = 'error' OR host ILIKE 'h1%' AS tagged, count(*) AS count FROM ev GROUP BY ALL")
def _(spark, d):
    e = M.event_types(ev(spark, d), {"failed": lambda: F.col("action") == "failure", "large": lambda: F.col("value") > 100})
    return Search(e.withColumn("tagged", M.tag([("source", "error"), ("host", "h1*")]))).stats("count", by=["event_types", "tagged"]).df


@R.add("m05_macro", "SELECT id FROM ev WHERE severity >= 3 AND src_ip NOT LIKE '10.0.1.%'")
def _(spark, d):
    macros = M.Macros()

    @macros.define("serious", "least", "outside")
    def _(s, least, outside):
        return s.where(F.col("severity") >= least).exclude("src_ip", [outside])

    return macros.apply(Search(ev(spark, d)), "serious", least=3, outside="10.0.1.0/24").fields("id").df


EVENTS = M.DataModel("events", lambda: F.col("value") > 0, {"ts": "timestamp", "host": "string", "source": "string", "value": "number", "k": "number"})
FAILURES = M.DataModel("failures", lambda: F.col("action") == "failure", {"src_ip": "ipv4"}, EVENTS)


@R.add("m07_pivot", "SELECT host, count(*) AS count, avg(CAST(json_extract_string(fields, '$.k') AS DOUBLE)) AS avg FROM ev WHERE value > 0 AND action = 'failure' AND value <= 150 GROUP BY host ORDER BY count DESC, host LIMIT 8")
def _(spark, d):
    return M.pivot(ev(spark, d), FAILURES, ["host"], ["count", ("avg", "k")], [("value", "<=", 150)], limit=8)


@R.add("m08_dataset", "SELECT source, count(*) AS n FROM ev WHERE value > 50 GROUP BY source")
def _(spark, d):
    M.register_dataset(Search(ev(spark, d)).where(F.col("value") > 50).df, "big_events")
    return spark.sql("SELECT source, count(*) AS n FROM big_events GROUP BY source")


# Sigma
RULE = {
    "logsource": {"category": "process_creation"}, "level": "high", "tags": ["attack.execution", "attack.t1059.004"],
    "detection": {"a": {"src_ip|startswith": "10.0.", "host": ["h1*", "h2"]}, "b1": {"value|gte": 100}, "b2": {"action": "failure"}, "no": {"k|re": "^[5-9]"}, "condition": "a and 1 of b* and not no"},
}


@R.add("d12_sigma", "SELECT id FROM ev WHERE source IN ('click', 'error') AND src_ip LIKE '10.0.%' AND (host ILIKE 'h1%' OR host = 'h2') AND (value >= 100 OR action = 'failure') AND NOT regexp_matches(json_extract_string(fields, '$.k'), '^[5-9]')")
def _(spark, d):
    e = ev(spark, d).withColumn("category", F.when(F.col("source") == "click", "process").when(F.col("source") == "error", "exec").otherwise("x"))
    return e.where(S.sigma_predicate(RULE, e.columns)).select("id")


@R.add("d13_sigma_delta", AL + "SELECT DISTINCT unnest(['T1110', 'T1078']) AS technique FROM al WHERE severity = 3")
def _(spark, d):
    a = alerts(spark, d)
    return S.sigma_coverage_delta(a.where("severity = 2"), a)


@R.add("d14_inert_fields", "SELECT 'r1' AS rule, 'user' AS field FROM (SELECT 1 FROM ev LIMIT 1)")
def _(spark, d):
    fields = spark.createDataFrame([("r1", "user"), ("r1", "k"), ("r2", "host")], "rule string, field string")
    return S.inert_fields(fields, S.observed_fields(ev(spark, d))).select("rule", "field")
