"""Readers on hand-written payloads, and the writers."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from secspark.operators import normalize as N
from secspark.sources import readers as R
from secspark.sources import sinks as K


def files(tmp_path, *texts):
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    return f"file://{tmp_path}"


def one(df):
    return [r.asDict() for r in df.collect()]


def test_envelopes(spark, tmp_path):
    p = files(tmp_path, json.dumps({"ts": 50, "host": "a", "kind": "events", "events": [{"message": "x", "fields": {"k": "v"}}, {"ts": 60, "host": "b", "source": "s", "severity": 2}]}), "not json")
    got = sorted((r["ts"], r["host"], r["source"], r["severity"], r["fields"]) for r in one(R.read_event_envelopes(spark, p)))
    assert got == [(50, "a", "agent", 0, '{"k":"v"}'), (60, "b", "s", 2, None)]


def test_journald(spark, tmp_path):
    line = {"__REALTIME_TIMESTAMP": "1704844800000001", "_COMM": "sshd", "MESSAGE": "Failed password for invalid user bob from [2001:db8::1]:22 port 1", "PRIORITY": "6", "__CURSOR": "c1", "_HOSTNAME": "h"}
    got = one(R.read_journald(spark, files(tmp_path, json.dumps(line) + "\n\nbroken\n" + json.dumps({"MESSAGE": "ok", "PRIORITY": "3"}))))
    got.sort(key=lambda r: r["source"])
    assert (got[0]["source"], got[0]["severity"]) == ("journal", 3)
    r = got[1]
    assert (r["ts"], r["source"], r["severity"], r["src_ip"], r["dedup"]) == (1704844800, "sshd", 3, "2001:db8::1", "c1")
    assert json.loads(r["fields"])["user"] == "bob" and json.loads(r["fields"])["action"] == "failure"


def test_collector_records(spark, tmp_path):
    good = '{"time": 1704844800123, "event": {"a": 1}, "sourcetype": "auditd", "fields": {"a": "9"}}'
    p = files(tmp_path, good + "{bad}" + '{"event": "text", "host": "h"}', "[" + good + "]", '{"nothing": 1}')
    got = one(R.read_hec(spark, p))
    assert sorted((r["ts"] or 0, r["category"] or "", r["message"][:4]) for r in got) == [(0, "", "text"), (1704844800, "endpoint", '{"a"'), (1704844800, "endpoint", '{"a"')]
    assert {json.loads(r["fields"])["a"] for r in got if r["category"]} == {"9"}
    assert R.bad_records(R.whole_files(spark, p)).first()[0] == 1


def test_traces(spark, tmp_path):
    span = {"traceId": "AB", "spanId": "CD", "name": "op", "kind": 2, "startTimeUnixNano": "1704844800000000000", "endTimeUnixNano": "1704844800005000000", "status": {"code": 2, "message": "no"}, "attributes": [{"key": "x", "value": {"intValue": "7"}}]}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}, {"key": "host.name", "value": {"stringValue": "n1"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span, {"name": "no ids"}]}]}]}
    (r,) = one(R.read_otlp_traces(spark, files(tmp_path, json.dumps(doc))))
    assert (r["ts"], r["source"], r["category"], r["severity"], r["host"], r["dedup"]) == (1704844800, "svc", "trace", 3, "n1", "otel-ab-cd")
    f = json.loads(r["fields"])
    assert (f["duration_ms"], f["otel.x"], f["span_kind"], f["scope_name"]) == ("5.0", "7", "server", "lib")


def test_log_push(spark, tmp_path):
    doc = {"streams": [{"stream": {"job": "web", "level": "error", "instance": "i"}, "values": [["1704844800000000000", "boom"], ["1704844801000000000", "again"]]}]}
    got = one(R.read_loki_push(spark, files(tmp_path, json.dumps(doc))))
    assert [(r["ts"], r["source"], r["severity"], r["host"], r["message"]) for r in got] == [(1704844800, "web", 3, "i", "boom"), (1704844801, "web", 3, "i", "again")]


def test_exposition(spark, tmp_path):
    p = files(tmp_path, '# HELP x\nup{a="1",b="x\\"y"} 2.5 1704844800000\nbad-name 1\nn NaN\ni +Inf\nplain 3\n')
    got = sorted((r["name"], r["ts"], json.loads(r["labels"]), r["value"]) for r in one(R.read_prom_exposition(spark, p, 9)))
    assert got == [("plain", 9, {}, 3.0), ("up", 1704844800, {"a": "1", "b": 'x"y'}, 2.5)]


def test_base64_payloads(spark, tmp_path):
    b = lambda s: base64.b64encode(s.encode()).decode()
    (tmp_path / "f").mkdir()
    p = files(tmp_path / "f", json.dumps({"records": [{"data": b('{"a":1}\n{"a":2}')}, {"data": b('{"logEvents":[{"a":3}]}')}, {"data": "@@"}]}))
    assert sorted(r["value"] for r in one(R.read_firehose(spark, p))) == ['{"a": 1}', '{"a": 2}', '{"a":3}']
    (tmp_path / "p").mkdir()
    p = files(tmp_path / "p", json.dumps({"message": {"data": b('{"m":1}')}}) + "\n" + json.dumps({"message": {"data": "!!"}}))
    assert [r["value"] for r in one(R.read_pubsub(spark, p))] == ['{"m":1}']
    assert R.decode_pubsub(R.lines(spark, p)).where("poison").count() == 1


def test_object_audit(spark, tmp_path):
    rec = lambda api, **k: json.dumps({"api": {"name": api, "bucket": k.pop("bucket", "backups"), "object": "o", "statusCode": 204}, "time": "2024-01-10T00:00:00.5Z", "remotehost": "[::1]", **k})
    p = files(tmp_path, "\n".join([rec("DeleteObject", requestID="r1", requestQuery={"versionId": "v"}), rec("GetObject"), rec("ListObjects"), rec("PutObject", bucket="other"), rec("PutObject", bucket="")]))
    got = sorted((r["severity"], r["dedup"], r["src_ip"], r["ts"]) for r in one(R.read_object_audit(spark, p, ["backups"])))
    assert got == [(3, "minioaudit-GetObject-backups-o", "::1", 1704844800), (4, "minioaudit-r1", "::1", 1704844800)]


def test_stix(spark, tmp_path):
    o = [{"type": "indicator", "id": "i1", "pattern": "[ipv4-addr:value = '1.2.3.4']", "confidence": 85, "valid_until": "2024-01-10T00:00:00Z"}, {"type": "indicator", "id": "i2", "pattern": "[a:b = 'c' AND d:e = 'f']"}, {"type": "malware"}]
    p = files(tmp_path, json.dumps({"type": "bundle", "objects": o}))
    (r,) = one(R.read_stix_bundle(spark, p))
    assert (r["type"], r["value"], r["severity"], r["expires"]) == ("ip", "1.2.3.4", 3, 1704844800)
    assert [x["skipped"] for x in one(R.decode_stix(R.whole_files(spark, p))) if x["skipped"]] == ["unsupported pattern"]


def test_syslog(spark):
    df = spark.createDataFrame([('<34>1 2024-01-10T00:00:00Z host app 12 ID7 [x@1 k="v"] hello',), ("<13>Jan 10 00:00:00 box cron[9]: run",), ("free text",)], "value string")
    a, b, c = one(R.parse_syslog(df))
    assert (a["ts"], a["source"], a["host"], a["severity"], a["message"], json.loads(a["fields"])["k"]) == (1704844800, "app", "host", 4, "hello", "v")
    assert (b["ts"], b["source"], b["host"], b["severity"], b["message"]) == (1704844800, "cron", "box", 1, "run")
    assert (c["source"], c["message"], c["ts"]) == ("syslog", "free text", None)


def test_firewall(spark):
    df = spark.createDataFrame([('date=2024-01-10 time=01:00:00 tz="+0100" devname="fw" type="utm" subtype="virus" level="warning" action="blocked" srcip=1.1.1.1 dstip=2.2.2.2 msg="bad file"',), ("eventtime=1704844800123456789 type=traffic level=notice action=accept",)], "value string")
    a, b = one(R.normalize_kv_firewall(df))
    assert (a["ts"], a["category"], a["severity"], a["host"], a["src_ip"], a["message"], json.loads(a["fields"])["action"]) == (1704844800, "malware", 2, "fw", "1.1.1.1", "bad file", "blocked")
    assert (b["ts"], b["category"], json.loads(b["fields"])["action"]) == (1704844800, "firewall", "allowed")


def test_endpoint(spark):
    rows = [{"rule": {"level": 7, "description": "d"}, "agent": {"name": "h"}, "data": {"sca": {"check": {"title": "t", "result": "failed"}}}}, {"data": {"vulnerability": {"cve": "CVE-1", "severity": "Critical"}}}, {"syscheck": {"path": "/etc/x", "event": "deleted"}}, {"rule": {"level": 12}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "payload string")
    assert [(r["category"], r["severity"]) for r in one(N.normalize_endpoint(df))] == [("posture", 2), ("vulnerability", 4), ("integrity", 3), ("endpoint", 4)]


def test_key_values_and_parsers(spark):
    df = spark.createDataFrame([("s", 'a=1 b="x y" a=2 c="q"', '{"b":"kept"}'), ("s", '{"a":"j"}', None), ("t", "a=1", None), ("s", None, None)], "source string, message string, fields string")
    got = [json.loads(r["fields"]) if r["fields"] else None for r in one(N.extract_generic(df, ["s"]))]
    assert got == [{"b": "kept", "a": "1", "c": "q"}, {"a": "j"}, None, None]
    many = spark.createDataFrame([("s", " ".join(f"k{i}={'v' * 300}" for i in range(40)), None)], df.schema)
    bag = json.loads(one(N.extract_generic(many, ["*"]))[0]["fields"])
    assert len(bag) == 24 and {len(v) for v in bag.values()} == {256}


def test_dedup_and_snapshots(spark):
    df = spark.createDataFrame([(1, 1, "a", "k"), (2, 2, "b", "k"), (3, 3, "a", "k"), (4, 4, "a", None), (5, 5, "a", None)], "id long, ts long, host string, dedup string")
    assert sorted(r["id"] for r in one(N.dedup_events(df))) == [1, 2, 4, 5]
    snaps = spark.createDataFrame([(1, 1, "s", "a", "x"), (2, 2, "s", "a", "x"), (3, 3, "s", "a", "y"), (4, 4, "s", "a", "x"), (5, 1, "s", "b", "x")], "id long, ts long, kind string, host string, hash string")
    got = sorted((r["host"], r["ts"], r["last_seen"], r["hash"], r["captures"]) for r in one(N.capture_snapshots(snaps)))
    assert got == [("a", 1, 2, "x", 2), ("a", 3, 3, "y", 1), ("a", 4, 4, "x", 1), ("b", 1, 1, "x", 1)]


def test_urls(spark):
    hidden = base64.urlsafe_b64encode(b"http://evil.example/x").decode().rstrip("=")
    df = spark.createDataFrame([(1, f'see http://a.example/p?u={hidden} and <a href="/rel">x</a>')], "id long, t string")
    got = {(r["url"], r["origin"]) for r in one(N.extract_urls(df, "t"))}
    assert got == {(f"http://a.example/p?u={hidden}", "text"), ("/rel", "html"), ("http://evil.example/x", "decoded")}


def test_cold_round_trip(spark, tmp_path):
    rows = [(i, 1_704_844_800 + i * 7200, "prod" if i % 2 else "lab", f"m{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts long, env_id string, message string")
    path, cut = f"file://{tmp_path}/cold", 1_704_844_800 + 50 * 7200
    K.write_cold(df, path, cut, files_per_day=2)
    K.write_cold(df, path, cut)  # the same days again replace themselves
    cold = spark.read.parquet(path)
    assert cold.count() == 50
    old = df.where(F.col("ts") < cut)
    assert K.verify_cold(cold, old).where("not ok").count() == 0
    assert K.verify_cold(cold.where("id <> 7"), old).where("not ok").count() == 1
    lo, hi = 1_704_844_800 + 7200 * 10, 1_704_844_800 + 7200 * 20
    assert sorted(r["id"] for r in one(R.read_cold(spark, path, "prod", lo, hi))) == [11, 13, 15, 17, 19]
    plan = R.read_cold(spark, path, "prod", lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(env_id" in plan


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=SUM(A1)"), (2, 'a,"b"'), (3, "@x")], "id int, c string")
    K.export_csv(df.coalesce(1), f"file://{tmp_path}/csv", limit=2)
    text = next((tmp_path / "csv").glob("part-*")).read_bytes() if len(list((tmp_path / "csv").glob("part-*"))) == 1 else b"".join(sorted(p.read_bytes() for p in (tmp_path / "csv").glob("part-*")))
    assert b"'=SUM(A1)" in text and b"\r\n" in text and b"# truncated" in text
    assert [r["line"] for r in one(K.csv_lines(df))] == ["1,'=SUM(A1)", '2,"a,""b"""', "3,'@x"]


def test_hec_files_of_lines_need_no_python(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"time": i + 1, "event": f"e{i} ] }} {{ [", "source": "s"})
    (tmp_path / "in" / "a b.json").write_text("\n".join(line(i) for i in range(5)) + "\n\n")
    native = R.read_hec(spark, f"file://{tmp_path}/in")
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString() and native.count() == 5
    (tmp_path / "in" / "c d.json").write_text(line(5) + line(6) + "\n" + line(7))  # two on one line
    (tmp_path / "in" / "e.json").write_text("[" + line(8) + "," + line(9) + "]")
    (tmp_path / "in" / "f.json").write_text(line(10) + "\n{broken\n" + line(11))
    (tmp_path / "in" / "g.json").write_text("")
    got = R.read_hec(spark, f"file://{tmp_path}/in")
    assert sorted(r["ts"] for r in got.collect()) == list(range(1, 13))
    tests = {'{"a":1}': True, ' {"a":[1,{"b":"]}"}]} ': True, '{"a":1}{"b":2}': False, '{"a":1},{"b":2}': False, "[1]": False, '{"a":1}]': False, '{"a":1}] {"b":2}': False, "{": False, "1": False, '"x"': False, "": False, '{"a":1} x': False}
    df = spark.createDataFrame([(k,) for k in tests], "t string").select("t", R.is_one_object(F.col("t")).alias("one"))
    assert {r["t"]: r["one"] for r in df.collect()} == tests


def test_collector_records_are_parsed_once(spark):
    texts = [
        '{"time":5,"host":"a","host":"b","event":{"k": 1.50, "k":[1, {"x":null}]},"fields":{"f":"1","f":"2"}}', '{"host":null,"host":"c","event":"{\\"k\\": 1}"}', '{"event":"tab\there","index":"i"}', '{"event":NaN,"host":"d"}', '{"host":"d","event":"x","n":NaN}',
        '{"fields":{"f":null}}', '{"fields":{}}', '{"event":"","fields":{"sourcetype":"own"},"sourcetype":"SSHD"}', '[{"event":1}]', '{"event":1} tail', '{"event":1, broken', '"text"', "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = R.decode_hec(df)
    j = lambda k: R.j("value", f"$.{k}")
    paths = df.where(j("event").isNotNull() | (F.size(N.json_map(j("fields"))) > 0)).select(j("host"), F.coalesce(j("source"), F.lit("hec")), F.coalesce(j("event"), F.lit("")))
    assert sorted(map(str, map(tuple, got.select("host", "source", "message").collect()))) == sorted(map(str, map(tuple, paths.collect())))
    assert [r["fields"] for r in got.where("host = 'a'").collect()] == ['{"f":"2","k":"[1,{\\"x\\":null}]"}']
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # the record, its fields and its event
    assert "get_json_object" not in plan and plan.count("from_json(") <= 3


def test_merge_computes_both_maps_once(spark):
    df = spark.createDataFrame([('{"a":"1","b":null}', '{"a":"2","b":"3","c":null,"d":"4"}'), (None, '{"a":"2"}'), ('{"a":"1"}', None), (None, None)], "x string, y string")
    got = df.select(N.to_bag(N.merge(N.json_map(F.col("x")), N.json_map(F.col("y")))).alias("m"))
    assert [r["m"] for r in got.collect()] == ['{"a":"1","b":null,"d":"4"}', '{"a":"2"}', '{"a":"1"}', None]
    assert got._jdf.queryExecution().analyzed().toString().count("from_json(") == 2


def test_syslog_patterns_run_once(spark):
    lines = [
        '<165>1 2024-01-10T00:00:01Z h app 7 ID [x@1 k="a\nb" q="\\]"][y z=1] msg\n', "<13>1 - - - - - -", "<34>Jan  9 22:14:15 h su[77]: failed\x01 x", "<34>Jan 19 22:14:15 h su: ", "<34>1 bad", "\n1\n2\n3", "<999>1 t h a p i - <34>Jan  9 22:14:15 h su: in", "<34>Jan 19 22:14:15 h su: a\nb", "", None,
    ]
    got = R.parse_syslog(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, value string").coalesce(1))
    assert [tuple(r) for r in got.select("ts", "source", "severity", "host", "message", "fields").collect()] == [
        (1704844801, "app", 1, "h", "msg", '{"facility":"20","pid":"7","msgid":"ID","k":"a\\nb","q":"\\\\ ","z":"1"}'),
        (None, "syslog", 1, None, "", '{"facility":"1"}'),
        (1704838455, "su", 4, "h", "failed\x01 x", '{"facility":"4","pid":"77"}'),
        (1705702455, "su", 4, "h", "", '{"facility":"4"}'),
        (None, "syslog", 0, None, "<34>1 bad", None),
        (None, "syslog", 0, None, "\n1\n2\n3", None),
        (None, "a", 0, "h", "<34>Jan  9 22:14:15 h su: in", '{"facility":"124","pid":"p","msgid":"i"}'),
        (None, "syslog", 0, None, "<34>Jan 19 22:14:15 h su: a\nb", None),
        (None, "syslog", 0, None, "", None),
        (None, "syslog", 0, None, None, None),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z][a-z]{2}") == 1 and plan.count(">1 (") == 1
