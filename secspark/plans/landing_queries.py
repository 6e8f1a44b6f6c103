"""Landed payloads, shipped parsers and the cold tier. Payload texts are made from the driver's events by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from secspark.operators import normalize as N
from secspark.operators import rollups as RU
from secspark.sources import readers as S
from secspark.sources import sinks as K
from secspark.vocabulary import PARSER_SPECS, REGEX_PARSERS

from .base import T0, T1, Registry, ev, work_dir
from .rollup_queries import _CAP, _ROLLUP

R = Registry()


def b64(c):
    return F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")


def text(form, *columns):
    """Text from a format and columns."""
    return F.format_string(form, *columns)


def got(key):
    return F.get_json_object("fields", f"$['{key}']")


@R.add("s03_hec", """SELECT ts, host, 'app' AS source, CASE source WHEN 'error' THEN 'auth' WHEN 'purchase' THEN 'firewall' WHEN 'signup' THEN 'web' END AS category, CASE WHEN id % 2 = 1 THEN '2' END AS a,
 CASE source WHEN 'error' THEN 'sshd' WHEN 'purchase' THEN 'pan:traffic' WHEN 'signup' THEN 'nginx:access' ELSE 'other' END AS sourcetype FROM ev""")
def _(spark, d):
    kind = F.when(F.col("source") == "error", "sshd").when(F.col("source") == "purchase", "pan:traffic").when(F.col("source") == "signup", "nginx:access").otherwise("other")
    event = F.when(F.col("id") % 2 == 1, '{"a":"1","a":"2"}').otherwise('"plain"')
    one = text('{"time":%d,"host":"%s","source":"app","sourcetype":"%s","event":%s}', F.col("ts"), F.col("host"), kind, event)
    landed = ev(spark, d).select(F.concat(one, F.lit(' {"broken": ')).alias("value"))
    return S.decode_hec(S.split_json(landed).where("ok")).select("ts", "host", "source", "category", got("a").alias("a"), got("sourcetype").alias("sourcetype"))


@R.add("s03b_hec_repeated_keys", "SELECT id, '2' AS a, host AS b FROM ev")
def _(spark, d):
    value = text('{"time":1,"event":{"a":"1","a":"2"},"fields":{"b":"x","b":"%s","id":"%d"}}', F.col("host"), F.col("id"))
    return S.decode_hec(ev(spark, d).select(value.alias("value"))).select(got("id").cast("long").alias("id"), got("a").alias("a"), got("b").alias("b"))


@R.add("s04_otlp_traces", """SELECT ts, source, 'trace' AS category, CASE WHEN action = 'failure' THEN 3 ELSE 0 END AS severity, host, action AS message, 'otel-' || lpad(id::VARCHAR, 32, '0') || '-' || lpad(id::VARCHAR, 16, '0') AS dedup, 'server' AS kind, '5.0' AS ms FROM ev""")
def _(spark, d):
    form = (
        '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"%s"}},{"key":"host.name","value":{"stringValue":"%s"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":['
        '{"traceId":"%s","spanId":"%s","name":"%s","kind":2,"startTimeUnixNano":"%d000000000","endTimeUnixNano":"%d005000000","status":{"code":%s}},{"traceId":"","spanId":"x"}]}]}]}'
    )
    c, n = F.col, F.col("id").cast("string")
    value = text(form, c("source"), c("host"), F.lpad(n, 32, "0"), F.lpad(n, 16, "0"), c("action"), c("ts"), c("ts"), F.when(c("action") == "failure", "2").otherwise("1"))
    return S.decode_otlp_traces(ev(spark, d).select(value.alias("value"))).select("ts", "source", "category", "severity", "host", "message", "dedup", got("span_kind").alias("kind"), got("duration_ms").alias("ms"))


@R.add("s05_loki", "SELECT ts, source, host, CASE WHEN severity = 1 THEN 0 ELSE severity END AS severity, action AS message FROM ev UNION ALL SELECT ts, source, host, CASE WHEN severity = 1 THEN 0 ELSE severity END, 'again' FROM ev")
def _(spark, d):
    c = F.col
    level = F.when(c("severity") == 3, "Error").when(c("severity") == 2, "warn").otherwise("info")
    value = text('{"streams":[{"stream":{"job":"first","app":"no","job":"%s","instance":"%s","level":"%s"},"values":[["%d000000000","%s"],["%d000000001","again"]]}]}', c("source"), c("host"), level, c("ts"), c("action"), c("ts"))
    return S.decode_loki(ev(spark, d).select(value.alias("value"))).select("ts", "source", "host", "severity", "message")


@R.add("s07_firehose", "SELECT id, action AS message FROM ev UNION ALL SELECT id + 1000000, NULL FROM ev")
def _(spark, d):
    data = b64(text('{"logEvents":[{"id":%d,"message":"%s"},{"id":%d}]}', F.col("id"), F.col("action"), F.col("id") + 1_000_000))
    value = text('{"records":[{"data":"%s"},{"data":"***"}]}', data)
    out = S.decode_firehose(ev(spark, d).select(value.alias("value")))
    return out.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.message").alias("message"))


@R.add("s08_pubsub", "SELECT CASE WHEN id % 10 <> 0 THEN id END AS id, id % 10 = 0 AS poison FROM ev")
def _(spark, d):
    data = F.when(F.col("id") % 20 == 0, "***").when(F.col("id") % 10 == 0, b64(F.lit("no json"))).otherwise(b64(text('{"id":"%d"}', F.col("id"))))
    out = S.decode_pubsub(ev(spark, d).select(text('{"message":{"data":"%s"}}', data).alias("value")))
    return out.select(F.when(~F.col("poison"), F.get_json_object("value", "$.id")).cast("long").alias("id"), "poison")


@R.add("s09_object_audit", """, a AS (SELECT *, CASE source WHEN 'error' THEN 'DeleteObject' WHEN 'purchase' THEN 'PutObject' WHEN 'signup' THEN 'GetObject' WHEN 'view' THEN 'ListBuckets' ELSE 'Other' END AS api FROM ev WHERE id % 11 <> 0)
 SELECT ts, 'minio-audit' AS source, 'data' AS category, CASE api WHEN 'DeleteObject' THEN 4 WHEN 'GetObject' THEN 3 WHEN 'PutObject' THEN 2 ELSE 1 END AS severity, src_ip, 'minioaudit-' || CASE WHEN id % 2 = 0 THEN 'r' || id ELSE api || '-' || host || '-o' || id END AS dedup,
 'minio-audit ' || api || ' ' || host || '/o' || id || ' status=OK code=204 ak=key src=' || src_ip || ' req=' || CASE WHEN id % 2 = 0 THEN 'r' || id ELSE '' END || CASE WHEN api = 'DeleteObject' THEN ' VERSION-DELETE' ELSE '' END AS message FROM a WHERE api <> 'ListBuckets'""")
def _(spark, d):
    c = F.col
    api = F.when(c("source") == "error", "DeleteObject").when(c("source") == "purchase", "PutObject").when(c("source") == "signup", "GetObject").when(c("source") == "view", "ListBuckets").otherwise("Other")
    value = text(
        '{"time":"%s","api":{"name":"%s","bucket":"%s","object":"o%d","status":"OK","statusCode":204},"remotehost":"[%s]","requestID":"%s","accessKey":"key","requestQuery":{"versionId":"v"}}',
        F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), api, F.when(c("id") % 11 == 0, "").otherwise(c("host")), c("id"), c("src_ip"), F.when(c("id") % 2 == 0, F.concat(F.lit("r"), c("id").cast("string"))).otherwise(""),
    )
    return S.decode_object_audit(ev(spark, d).select(value.alias("value"))).select("ts", "source", "category", "severity", "src_ip", "dedup", "message")


@R.add("s10b_preset", "SELECT ts, 'okta' AS source, 'auth' AS category, CASE WHEN severity = 3 THEN 3 ELSE 0 END AS severity, src_ip, id::VARCHAR AS dedup, host AS user, source AS target FROM ev")
def _(spark, d):
    c = F.col
    value = text(
        '{"uuid":"%d","published":"%s","severity":"%s","client":{"ipAddress":"%s"},"actor":{"alternateId":"%s"},"target":[{"displayName":"%s"}]}',
        c("id"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(c("severity") == 3, "ERROR").otherwise("INFO"), c("src_ip"), c("host"), c("source"),
    )
    return S.map_preset(ev(spark, d).select(value.alias("value")), "okta").select("ts", "source", "category", "severity", "src_ip", "dedup", got("user").alias("user"), got("target").alias("target"))


@R.add("s11_stix", f"SELECT CASE WHEN id % 5 <> 0 THEN 'ip' END AS type, CASE WHEN id % 5 <> 0 THEN src_ip END AS value, CASE WHEN severity = 3 THEN 90 ELSE 50 END AS confidence, CASE WHEN severity = 3 THEN 3 ELSE 2 END AS severity, {T1} AS expires, 'indicator--' || id AS stix_id, CASE WHEN id % 5 = 0 THEN 'unsupported pattern' END AS skipped FROM ev")
def _(spark, d):
    c = F.col
    pattern = F.when(c("id") % 5 == 0, "[mutex:name = 'x'] AND [y]").otherwise(text("[ipv4-addr:value = '%s']", c("src_ip")))
    value = text('{"type":"bundle","objects":[{"type":"indicator","id":"indicator--%d","pattern":"%s","confidence":%s,"valid_until":"2024-02-01T00:00:00Z"},{"type":"malware"}]}', c("id"), pattern, F.when(c("severity") == 3, "90").otherwise("50"))
    return S.decode_stix(ev(spark, d).select(value.alias("value"))).select("type", F.when(F.col("skipped").isNull(), F.col("value")).alias("value"), "confidence", "severity", "expires", "stix_id", "skipped")


@R.add("s12_syslog", "SELECT ts, host, source, severity, action || ' from ' || src_ip AS message, CASE WHEN id % 3 <> 2 THEN id::VARCHAR END AS pid FROM ev WHERE id % 3 <> 2 UNION ALL SELECT NULL, NULL, 'syslog', 0, 'no header ' || id, NULL FROM ev WHERE id % 3 = 2")
def _(spark, d):
    c, n = F.col, F.col("id") % 3
    priority = (F.lit(32) + F.when(c("severity") == 3, 3).when(c("severity") == 2, 4).when(c("severity") == 1, 5).otherwise(6)).cast("string")
    at = F.timestamp_seconds("ts")
    new = text('<%s>1 %s %s %s %s ID1 [x@1 k="v"] %s from %s', priority, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c("host"), c("source"), c("id").cast("string"), c("action"), c("src_ip"))
    old = text("<%s>%s %s %s %s[%s]: %s from %s", priority, F.date_format(at, "MMM"), F.concat(F.lpad(F.date_format(at, "d"), 2, " "), F.lit(" "), F.date_format(at, "HH:mm:ss")), c("host"), c("source"), c("id").cast("string"), c("action"), c("src_ip"))
    value = F.when(n == 0, new).when(n == 1, old).otherwise(text("no header %d", c("id")))
    return S.parse_syslog(ev(spark, d).select(value.alias("value"))).select("ts", "host", "source", "severity", "message", got("pid").alias("pid"))


@R.add("s13_kv_firewall", "SELECT ts, CASE source WHEN 'error' THEN 'malware' WHEN 'purchase' THEN 'ids' ELSE 'firewall' END AS category, CASE WHEN severity = 3 THEN 4 ELSE 2 END AS severity, host, src_ip, CASE WHEN severity = 3 THEN 'blocked' ELSE 'allowed' END AS action, 'seen ' || id AS message FROM ev")
def _(spark, d):
    c = F.col
    value = text(
        'devname="%s" type="%s" subtype="%s" level="%s" eventtime=%d srcip=%s dstip=10.9.9.9 action="%s" msg="seen %d"',
        c("host"), F.when(c("source") == "purchase", "utm").otherwise("traffic"), F.when(c("source") == "error", "virus").otherwise("forward"), F.when(c("severity") == 3, "alert").otherwise("warning"), c("ts"), c("src_ip"),
        F.when(c("severity") == 3, "deny").otherwise("accept"), c("id"),
    )
    return S.normalize_kv_firewall(ev(spark, d).select(value.alias("value"))).select("ts", "category", "severity", "host", "src_ip", got("action").alias("action"), "message")


def _cold(spark, d):
    path = work_dir(spark, "cold")
    K.write_cold(ev(spark, d), path, T1 - 86400)
    return path


@R.add("k01_write_cold", f"SELECT 'prod' AS env_id, CAST(to_timestamp(ts) AS DATE) AS day, count(*) AS n, sum(id)::BIGINT AS ids FROM ev WHERE ts < {T1 - 86400} GROUP BY 2")
def _(spark, d):
    return spark.read.parquet(_cold(spark, d)).groupBy("env_id", "day").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@R.add("s14_read_cold", f"SELECT id, ts, host FROM ev WHERE ts BETWEEN {T0 + 1000} AND {T0 + 200000}")
def _(spark, d):
    return S.read_cold(spark, _cold(spark, d), "prod", T0 + 1000, T0 + 200000).select("id", "ts", "host")


@R.add("r11_cold_rollup", _CAP.replace("FROM ev", f"FROM ev WHERE ts >= {T0} AND ts < {T0 + 86400}") + _ROLLUP)
def _(spark, d):
    return RU.cold_rollup(K.with_day(ev(spark, d)), "2024-01-10", [("error", "host")], min_sev=3, topn=2)[0]


@R.add("n03b_shipped_parsers", """SELECT id, CASE id % 5 WHEN 2 THEN 'integrity' WHEN 4 THEN NULL ELSE 'firewall' END AS category, CASE WHEN id % 5 IN (2, 4) THEN severity ELSE 2 END AS severity, CASE WHEN id % 5 IN (0, 1, 3) THEN src_ip END AS src_ip, CASE id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'deny' WHEN 3 THEN 'deny' END AS action,
 CASE id % 5 WHEN 0 THEN '/p' || id WHEN 2 THEN '/etc/' || host END AS path, CASE id % 5 WHEN 1 THEN host END AS vendor, CASE id % 5 WHEN 2 THEN 'modified' END AS fim_event, CASE id % 5 WHEN 3 THEN '22' END AS dst_port, CASE id % 5 WHEN 3 THEN 'portscan' END AS signal FROM ev""")
def _(spark, d):
    c, n = F.col, F.col("id") % 5
    message = (
        F.when(n == 0, text('{"clientIP":"%s","action":"block","clientRequestPath":"/p%d"}', c("src_ip"), c("id")))
        .when(n == 1, text("devname=%s action=deny src=%s dst=10.9.9.9 proto=6", c("host"), c("src_ip")))
        .when(n == 2, text("path=/etc/%s event=modified sha256=aa", c("host")))
        .when(n == 3, text("PORTSCAN4: SRC=%s DST=10.9.9.9 DPT=22 PROTO=TCP", c("src_ip")))
        .otherwise("nothing")
    )
    source = F.get(F.array(*[F.lit(x["source"]) for x in PARSER_SPECS], F.lit("none")), n.cast("int"))
    rows = ev(spark, d).select("id", source.alias("source"), message.alias("message"), "severity", F.lit(None).cast("string").alias("src_ip"), F.lit("{}").alias("fields"))
    out = N.apply_declarative_parsers(rows, PARSER_SPECS)
    return out.select("id", "category", "severity", "src_ip", *[got(k).alias(k) for k in ("action", "path", "vendor", "fim_event", "dst_port", "signal")])


@R.add("n01b_shipped_regex", "SELECT id, 'GET' AS method, '/' || host AS path, '200' AS status FROM ev")
def _(spark, d):
    message = text('%s - - "GET /%s HTTP/1.1" 200 %d', F.col("src_ip"), F.col("host"), F.col("id"))
    out = N.apply_regex_parsers(ev(spark, d).select("id", F.lit("nginx").alias("source"), message.alias("message"), F.lit(None).cast("string").alias("fields")), REGEX_PARSERS)
    return out.select("id", got("method").alias("method"), got("path").alias("path"), got("status").alias("status"))


@R.add("n02b_repeated_keys", "SELECT id, host AS a, 'kept' AS b, '1.3' AS cim FROM ev")
def _(spark, d):
    message, fields = text('{"a":"x","b":"y","a":"%s"}', F.col("host")), F.lit('{"b":"lost","b":"kept"}')
    out = N.stamp_version(N.extract_generic(ev(spark, d).select("id", "source", message.alias("message"), fields.alias("fields")), ["*"]))
    return out.select("id", got("a").alias("a"), got("b").alias("b"), got("cim").alias("cim"))


@R.add("n04_endpoint", """SELECT host, CASE id % 5 WHEN 0 THEN 'posture' WHEN 1 THEN 'vulnerability' WHEN 2 THEN 'integrity' WHEN 3 THEN 'inventory' ELSE 'endpoint' END AS category,
 CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE CASE WHEN severity = 3 THEN 4 ELSE 1 END END AS severity, 'rule ' || id AS message, CASE id % 5 WHEN 1 THEN 'CVE-' || id END AS vuln_id, CASE id % 5 WHEN 2 THEN '/etc/' || host END AS fim_path FROM ev""")
def _(spark, d):
    c, n = F.col, F.col("id") % 5
    own = (
        F.when(n == 0, '"data":{"sca":{"policy":"p","check":{"title":"t","result":"failed"}}},')
        .when(n == 1, text('"data":{"vulnerability":{"cve":"CVE-%d","severity":"Critical"}},', c("id")))
        .when(n == 2, text('"syscheck":{"path":"/etc/%s","event":"deleted"},', c("host")))
        .when(n == 3, '"data":{"program":{"name":"vim","version":"9"}},')
        .otherwise("")
    )
    payload = text('{%s"rule":{"id":"1","level":%s,"description":"rule %d"},"agent":{"name":"%s"}}', own, F.when(c("severity") == 3, "12").otherwise("3"), c("id"), c("host"))
    out = N.normalize_endpoint(ev(spark, d).select(payload.alias("payload")))
    return out.select("host", "category", "severity", "message", got("vuln_id").alias("vuln_id"), got("fim_path").alias("fim_path"))


@R.add("n07b_vocabulary", "SELECT id, CASE id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'mail-phishing' WHEN 2 THEN 'bogus' END AS category, CASE id % 4 WHEN 2 THEN 'off-vocabulary' WHEN 3 THEN 'absent' ELSE 'canonical' END AS category_state FROM ev")
def _(spark, d):
    given = F.get(F.array(F.lit("auth"), F.lit(""), F.lit("bogus"), F.lit(None).cast("string")), (F.col("id") % 4).cast("int"))
    parsed = F.when(F.col("id") % 4 == 1, "mail-phishing")
    return N.resolve_category(ev(spark, d).select("id", given.alias("category"), parsed.alias("parser_category")), parsed="parser_category").select("id", "category", "category_state")


@R.add("n09b_iocs_without_ids", "SELECT CASE WHEN id % 3 <> 0 THEN 7 END AS id, src_ip, CASE WHEN src_ip LIKE '10.0.1.%' THEN src_ip END AS ti_match, src_ip LIKE '10.0.1.%' AS threat_intel FROM ev")
def _(spark, d):
    e = ev(spark, d).withColumn("id", F.when(F.col("id") % 3 != 0, F.lit(7).cast("long")))
    ips = e.where(F.col("src_ip").startswith("10.0.1.")).select(F.lit("ip").alias("type"), F.col("src_ip").alias("value"), F.lit("feed").alias("source"), F.lit(90).alias("confidence"), F.lit(3).alias("severity"), F.lit(None).cast("long").alias("expires")).distinct()
    return N.match_iocs(e, ips, T0).select("id", "src_ip", "ti_match", "threat_intel")
