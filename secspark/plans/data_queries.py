"""Normalisation, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from secspark.operators import normalize as N
from secspark.sources import readers as S
from secspark.sources import sinks as K

from .base import T0, T1, Registry, ev, table

R = Registry()


def raw(spark, d):
    """Events as log lines: a key-value line for errors, JSON for the rest."""
    kv = F.concat(F.lit("user="), "host", F.lit(' ip="'), "src_ip", F.lit('" code='), F.get_json_object("fields", "$.k"))
    js = F.to_json(F.struct(F.col("host").alias("user"), F.col("src_ip").alias("ip"), F.get_json_object("fields", "$.k").alias("code")))
    return ev(spark, d).select("id", "ts", "source", "severity", "host", F.when(F.col("source") == "error", kv).otherwise(js).alias("message"), F.lit(None).cast("string").alias("fields"))


@R.add("n01_regex_parsers", "SELECT id, CASE WHEN source = 'error' THEN host END AS user, CASE WHEN source = 'error' THEN src_ip END AS ip FROM ev")
def _(spark, d):
    out = N.apply_regex_parsers(raw(spark, d), [("error", r"user=(?P<user>\S+) ip=\"(?P<ip>[^\"]+)"), ("*", r"^nothing (?<x>.)")])
    return out.select("id", F.get_json_object("fields", "$.user").alias("user"), F.get_json_object("fields", "$.ip").alias("ip"))


@R.add("n02_extract_generic", "SELECT id, host AS user, src_ip AS ip, json_extract_string(fields, '$.k') AS code FROM ev")
def _(spark, d):
    out = N.extract_generic(raw(spark, d), ["*"])
    return out.select("id", *[F.get_json_object("fields", f"$.{k}").alias(k) for k in ("user", "ip", "code")])


@R.add("n03_declarative", "SELECT id, CASE WHEN source = 'error' THEN 'auth' END AS category, CASE WHEN source = 'error' THEN 4 ELSE severity END AS severity, CASE WHEN source = 'error' THEN src_ip END AS src_ip, CASE WHEN source = 'error' THEN 'blocked' END AS action FROM ev")
def _(spark, d):
    spec = {"source": "error", "guard": "^user=", "extract": [{"kv": True}], "map": {"category": "auth", "severity": "4", "src_ip": "$ip", "action": "blocked"}}
    wrong = {"source": "error", "extract": [], "map": {"category": "late", "severity": "9"}}
    out = N.apply_declarative_parsers(raw(spark, d), [spec, wrong])
    return out.select("id", "category", "severity", "src_ip", F.get_json_object("fields", "$.action").alias("action"))


@R.add("n05_promote", "SELECT id, CASE WHEN id % 2 = 0 THEN src_ip ELSE '1.2.3.4' END AS src_ip, CASE WHEN id % 2 = 0 THEN 'http://' || host END AS url FROM ev")
def _(spark, d):
    e = ev(spark, d)
    e = e.select("id", F.when(F.col("id") % 2 == 1, "1.2.3.4").alias("src_ip"), F.to_json(F.struct(F.col("src_ip").alias("rhost"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://"), "host")).alias("url"))).alias("fields"))
    return N.promote_columns(e).select("id", "src_ip", "url")


@R.add("n06_auth_fields", "SELECT id, host AS user, CASE WHEN action = 'failure' THEN 'failure' ELSE 'success' END AS action, src_ip, CASE WHEN action = 'failure' THEN 3 ELSE severity END AS severity FROM ev")
def _(spark, d):
    e = ev(spark, d)
    m = F.when(F.col("action") == "failure", F.concat(F.lit("Failed password for invalid user "), "host", F.lit(" from "), "src_ip", F.lit(" port 22"))).otherwise(F.concat(F.lit("Accepted publickey for "), "host", F.lit(" from "), "src_ip", F.lit(" port 22")))
    out = N.derive_auth_fields(e.select("id", "severity", m.alias("message"), F.lit(None).cast("string").alias("src_ip"), F.lit(None).cast("string").alias("fields")))
    return out.select("id", F.get_json_object("fields", "$.user").alias("user"), F.get_json_object("fields", "$.action").alias("action"), "src_ip", "severity")


@R.add("n07_category_stamp", "SELECT id, CASE WHEN source <> 'view' THEN source END AS category, CASE WHEN source = 'view' THEN 'absent' WHEN source IN ('error', 'click') THEN 'canonical' ELSE 'off-vocabulary' END AS category_state, 'v1' AS cim FROM ev")
def _(spark, d):
    e = ev(spark, d).withColumn("category", F.when(F.col("source") == "view", "").otherwise(F.col("source")))
    out = N.stamp_version(N.resolve_category(e, ["error", "click"]), "v1")
    return out.select("id", "category", "category_state", F.get_json_object("fields", "$.cim").alias("cim"))


@R.add("n09_match_iocs", f"SELECT id, CASE WHEN src_ip LIKE '10.0.1.%' THEN src_ip WHEN host = 'h4' THEN 'h4' END AS ti_match, CASE WHEN src_ip LIKE '10.0.1.%' THEN 90 WHEN host = 'h4' THEN 50 END AS ti_confidence, src_ip LIKE '10.0.1.%' OR host = 'h4' AS threat_intel FROM ev")
def _(spark, d):
    e = ev(spark, d)
    ips = e.where(F.col("src_ip").startswith("10.0.1.")).select(F.lit("ip").alias("type"), F.concat(F.lit(" "), "src_ip").alias("value"), F.lit("feed").alias("source"), F.lit(90).alias("confidence"), F.lit(3).alias("severity"), F.lit(0).cast("long").alias("expires")).distinct()
    more = spark.createDataFrame([("domain", "H4", "feed", 50, 2, T1), ("domain", "h5", "old", 50, 2, T0 - 1)], ips.schema)
    out = N.match_iocs(e.withColumn("fields", F.to_json(F.struct(F.col("host").alias("domain")))), ips.union(more), T0)
    return out.select("id", "ti_match", "ti_confidence", "threat_intel")


@R.add("n10_tag_scope", f"SELECT id, CASE WHEN src_ip LIKE '10.0.1.%' AND ts BETWEEN {T0} AND {T1} THEN 'a' WHEN src_ip LIKE '10.0.%' AND ts < {T0} THEN 'b' END AS engagement_id FROM ev")
def _(spark, d):
    scopes = spark.createDataFrame([("a", "10.0.1.", True, T0, T1), ("b", "10.0.", True, 0, T0 - 1), ("c", "10.0.1.2", False, T0, T1)], "id string, matcher string, is_prefix boolean, window_start long, window_end long")
    return N.tag_scope(ev(spark, d), scopes).select("id", "engagement_id")


@R.add("n11_processors", "SELECT id, CASE WHEN source = 'error' THEN '[redacted]' ELSE host END AS host, CASE WHEN source = 'signup' THEN 'lab' ELSE 'prod' END AS env_id FROM ev WHERE source <> 'view'")
def _(spark, d):
    rules = [{"field": "source", "op": "eq", "value": "view", "action": "drop"}, {"field": "source", "op": "contains", "value": "rro", "action": "mask", "arg": "host"}, {"field": "source", "op": "regex", "value": "^sign", "action": "route", "arg": "lab"}, {"field": "nothing", "op": "any", "action": "drop"}]
    return N.apply_processors(ev(spark, d), rules).select("id", "host", "env_id")


@R.add("n11b_processor_counts", "SELECT 'r1' AS rule, count(*) FILTER (WHERE source = 'view') AS matched FROM ev UNION ALL SELECT 'r2', count(*) FILTER (WHERE source <> 'error') FROM ev")
def _(spark, d):
    return N.processor_counts(ev(spark, d), [{"id": "r1", "field": "source", "op": "eq", "value": "view"}, {"id": "r2", "field": "source", "op": "ne", "value": "error"}])


@R.add("n12_sample_every_n", "SELECT id FROM ev QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts, id) % 10 = 1")
def _(spark, d):
    return N.sample_every_n(ev(spark, d), 10, "host").select("id")


@R.add("n13_dedup_events", "SELECT id FROM ev QUALIFY id % 7 = 0 OR row_number() OVER (PARTITION BY host, CASE WHEN id % 7 <> 0 THEN json_extract_string(fields, '$.k') END ORDER BY ts, id) = 1")
def _(spark, d):
    return N.dedup_events(ev(spark, d).withColumn("dedup", F.when(F.col("id") % 7 != 0, F.get_json_object("fields", "$.k")))).select("id")


_S = ", s AS (SELECT id, ts, 'state' AS kind, host, action AS hash FROM ev)"


@R.add("n14_capture_snapshots", _S + ", c AS (SELECT *, coalesce(lag(hash) OVER w <> hash, true) AS new FROM s WINDOW w AS (PARTITION BY kind, host ORDER BY ts, id)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY kind, host ORDER BY ts, id) AS run FROM c) SELECT kind, host, min(ts) AS ts, max(ts) AS last_seen, min(hash) AS hash, count(*) AS captures FROM r GROUP BY kind, host, run")
def _(spark, d):
    return N.capture_snapshots(ev(spark, d).select("id", "ts", F.lit("state").alias("kind"), "host", F.col("action").alias("hash")))


@R.add("n15_latest_snapshot", _S + "SELECT host, id, hash FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) = 1")
def _(spark, d):
    s = ev(spark, d).select("id", "ts", F.lit("state").alias("kind"), "host", F.col("action").alias("hash"))
    return N.latest_snapshot_per_host(s, "state").select("host", "id", "hash")


@R.add("n16_diff_baseline", f", a AS (SELECT src_ip, max(id) AS h FROM ev WHERE ts < {T0} AND id % 50 < 25 GROUP BY 1), b AS (SELECT src_ip, max(id) AS h FROM ev WHERE ts < {T0} + 86400 AND id % 50 >= 10 GROUP BY 1) SELECT src_ip, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change, a.h AS old, b.h AS new FROM a FULL JOIN b USING (src_ip) WHERE a.h IS DISTINCT FROM b.h")
def _(spark, d):
    e = ev(spark, d)
    a = e.where((F.col("ts") < T0) & (F.col("id") % 50 < 25)).groupBy("src_ip").agg(F.max("id").alias("hash"))
    b = e.where((F.col("ts") < T0 + 86400) & (F.col("id") % 50 >= 10)).groupBy("src_ip").agg(F.max("id").alias("hash"))
    return N.diff_baseline(b, a, ["src_ip"])


@R.add("n17_reparse", f"SELECT id, CASE WHEN source = 'error' AND ts >= {T0} THEN host END AS user FROM ev")
def _(spark, d):
    return N.reparse(raw(spark, d), [("error", r"user=(?P<user>\S+)")], T0).select("id", F.get_json_object("fields", "$.user").alias("user"))


@R.add("n18_relabel", f"SELECT id, CASE WHEN source = 'error' AND host = 'h3' AND ts BETWEEN {T0} AND {T0 + 36000} THEN 1 ELSE severity END AS severity, CASE WHEN source = 'error' AND host = 'h3' AND ts BETWEEN {T0} AND {T0 + 36000} THEN '3' END AS original FROM ev")
def _(spark, d):
    e = ev(spark, d).withColumn("category", F.when(F.col("source") == "error", "integrity").otherwise("x")).withColumn("fields", F.to_json(F.struct(F.concat(F.lit("/etc/"), "host").alias("path"), F.lit("aa").alias("hash"))))
    deploys = spark.createDataFrame([("h3", "aa", T0), ("h4", "bb", T0)], "name string, hash string, deployed_at long")
    return N.relabel_corroborated(e, deploys, 36000).select("id", "severity", F.get_json_object("fields", "$.severity_original").alias("original"))


@R.add("n19_scan_patterns", "SELECT doc_id, 'text' AS column, 'ip' AS pattern FROM documents WHERE regexp_matches(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b') UNION ALL SELECT doc_id, 'text', 'mail' FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+')", events=False)
def _(spark, d):
    return N.scan_patterns(table(spark, d, "documents"), {"ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "mail": r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"}, ["text"], "doc_id")


@R.add("n19b_extract_urls", """SELECT DISTINCT page_id, u.u AS url, u.o AS origin FROM (SELECT page_id, unnest(list_concat(list_transform(regexp_extract_all(html, '(?i)\\bhttps?://[^\\s<>"''\\\\)\\]}]+'), lambda x: {'u': x, 'o': 'text'}), list_transform(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']([^"''\\s>]+)["'']', 1), lambda x: {'u': x, 'o': 'html'}))) AS u FROM pages)""", events=False)
def _(spark, d):
    return N.extract_urls(table(spark, d, "pages"), "html", "page_id").where("origin <> 'decoded'")


@R.add("n08_reserve_source", "SELECT CASE WHEN source = 'error' THEN 'ext:secspark-x' ELSE source END AS source, count(*) AS n FROM ev GROUP BY 1")
def _(spark, d):
    e = ev(spark, d).withColumn("source", F.when(F.col("source") == "error", "secspark-x").otherwise(F.col("source")))
    return N.reserve_source(e).groupBy("source").agg(F.count("*").alias("n"))


@R.add("s01_envelopes", "SELECT ts, host, source, message FROM (SELECT CASE WHEN id % 2 = 0 THEN ts ELSE 77 END AS ts, host, CASE WHEN id % 3 = 0 THEN 'agent' ELSE source END AS source, action AS message FROM ev)")
def _(spark, d):
    e = ev(spark, d)
    event = F.struct(F.when(F.col("id") % 2 == 0, F.col("ts")).alias("ts"), F.when(F.col("id") % 3 != 0, F.col("source")).alias("source"), F.col("action").alias("message"))
    value = F.to_json(F.struct(F.lit(77).alias("ts"), "host", F.lit("events").alias("kind"), F.array(event).alias("events")))
    return S.decode_envelopes(e.select(value.alias("value"))).select("ts", "host", "source", "message")


@R.add("s02_journald", "SELECT ts, host, source, CASE WHEN action = 'failure' THEN 3 WHEN id % 4 = 0 THEN 2 ELSE 0 END AS severity, src_ip, 'c' || id AS dedup FROM ev")
def _(spark, d):
    e = ev(spark, d)
    m = F.concat(F.when(F.col("action") == "failure", "Failed password").otherwise("Accepted password"), F.lit(" for root from "), "src_ip", F.lit(" port 1"))
    v = F.to_json(F.struct((F.col("ts") * 1_000_000).cast("string").alias("__REALTIME_TIMESTAMP"), F.col("source").alias("_COMM"), F.col("host").alias("_HOSTNAME"), m.alias("MESSAGE"), F.when(F.col("id") % 4 == 0, "4").otherwise("6").alias("PRIORITY"), F.concat(F.lit("c"), "id").alias("__CURSOR")))
    return S.decode_journald(e.select(v.alias("value"))).select("ts", "host", "source", "severity", "src_ip", "dedup")


@R.add("s06_exposition", "SELECT ts, source AS name, host, value FROM ev WHERE source <> 'view'")
def _(spark, d):
    v = F.concat("source", F.when(F.col("source") == "view", "").otherwise(F.concat(F.lit('{host="'), "host", F.lit('",q="a\\"b"}'))), F.lit(" "), F.when(F.col("source") == "view", "NaN").otherwise(F.col("value").cast("string")), F.lit(" "), (F.col("ts") * 1000).cast("string"))
    out = S.decode_exposition(ev(spark, d).select(v.alias("value")), 0)
    return out.select("ts", "name", F.get_json_object("labels", "$.host").alias("host"), "value")


@R.add("s10_map_records", "SELECT ts, 'api' AS source, src_ip, severity, CAST(id AS VARCHAR) AS dedup, host AS user FROM ev")
def _(spark, d):
    e = ev(spark, d)
    v = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct((F.col("ts") * 1000).alias("ms")).alias("time"), F.col("src_ip").alias("addr"), "severity", "id", F.col("host").alias("who"))).alias("items")).alias("data")))
    out = S.map_records(e.select(v.alias("value")), {"ts": "$.time.ms", "source": "=api", "src_ip": "$.addr", "severity": "$.severity", "dedup": "$.id", "fields.user": "$.who"}, "$.data.items[*]")
    return out.select("ts", "source", "src_ip", "severity", "dedup", F.get_json_object("fields", "$.user").alias("user"))


@R.add("k02_verify_cold", "SELECT 'prod' AS env_id, CAST(to_timestamp(ts) AS DATE) AS day, count(*) AS expected, count(*) FILTER (WHERE id <> 4242) AS found, count(*) FILTER (WHERE id = 4242) = 0 AS ok FROM ev GROUP BY 2")
def _(spark, d):
    e = ev(spark, d)
    return K.verify_cold(e.where("id <> 4242"), e)


@R.add("k03_csv", "SELECT id || ',' || CASE WHEN id % 3 = 0 THEN chr(39) || '=1+1' WHEN id % 3 = 1 THEN '\"a,\"\"b\"\"\"' ELSE '' END AS line FROM ev")
def _(spark, d):
    return K.csv_lines(ev(spark, d).select("id", F.when(F.col("id") % 3 == 0, "=1+1").when(F.col("id") % 3 == 1, 'a,"b"').alias("c")))


@R.add("k04_records", """SELECT '{"id":' || id || ',"host":"' || host || '"}' AS record FROM ev""")
def _(spark, d):
    return K.export_records(ev(spark, d).select("id", "host"))


@R.add("k05_forward", "SELECT id, '<' || CASE severity WHEN 3 THEN 11 ELSE 12 END || '>1 ' || strftime(to_timestamp(ts), '%Y-%m-%dT%H:%M:%SZ') || ' ' || host || ' ' || source || ' - - - ' || action AS body FROM ev WHERE severity >= 2 AND id > 3000")
def _(spark, d):
    return K.forward(ev(spark, d).withColumn("message", F.col("action")), F.col("severity") >= 2, "rfc5424", 3000)


@R.add("k06_upsert_lookup", """SELECT 'banned' AS name, src_ip AS key, '{"id":' || max(id) || ',"ts":' || max(ts) || '}' AS val FROM ev WHERE severity = 3 GROUP BY src_ip UNION ALL SELECT 'other', 'x', '{}'""")
def _(spark, d):
    old = spark.createDataFrame([("other", "x", "{}"), ("banned", "10.0.1.2", "{}")], "name string, key string, val string")
    a = ev(spark, d).where("severity = 3").select("id", "ts", "src_ip")
    known = a.select(F.lit("banned").alias("name"), F.col("src_ip").alias("key")).distinct()
    old = old.where("name = 'other'").unionByName(old.where("name = 'banned'").join(known, ["name", "key"], "left_semi"))
    return K.upsert_lookup(old, a, "banned", "src_ip")
