"""Detection, rollups, governance, panels: hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from secspark.operators import detect as D
from secspark.operators import govern as G
from secspark.operators import panels as N
from secspark.operators import risk as K
from secspark.operators import rollups as R
from secspark.operators import sigma as S
from secspark.operators.normalize import dedup_events, match_iocs, sample_every_n
from secspark.operators.search import Search

EV = "id long, ts long, source string, severity int, action string, host string, src_ip string, fields string"


@pytest.mark.parametrize(
    "lists,counts,match",
    [
        ([[10, 11, 12], [20]], [3, 1], True),
        ([[10, 11, 12], [5]], [3, 1], False),
        ([[10, 11, 12], []], [3, 1], False),
        ([[10, 11], [20]], [3, 1], False),
        ([[1], [2], [3]], [1, 1, 1], True),
        ([[3], [2], [1]], [1, 1, 1], False),
    ],
)
def test_sequence(spark, lists, counts, match):
    rows = [(f"s{i}", t, "e") for i, ts in enumerate(lists) for t in ts] or [("x", 0, "e")]
    df = spark.createDataFrame(rows, "source string, ts long, entity string")
    steps = [(F.col("source") == f"s{i}", n) for i, n in enumerate(counts)]
    assert (D.correlate_sequence(df, steps, "entity", 0, 100).count() == 1) is match


@pytest.mark.parametrize("history,value,fires,scored", [([4, 5, 6, 5, 4, 6, 5, 4, 6, 5], 5, False, True), ([4, 5, 6, 5, 4, 6, 5, 4, 6, 5], 50, True, True), ([5, 6, 7], 50, False, False), ([5] * 5, 50, False, False)])
def test_baseline(spark, history, value, fires, scored):
    rows = [(b * 100 + k,) for b, n in enumerate([*history, value]) for k in range(n)]
    df = spark.createDataFrame(rows, "ts long").withColumn("host", F.lit("h"))
    last = len(history) * 100
    z = {r["bucket"]: r["z"] for r in D.baseline_scores(df, "host", 100, 10_000, 5).collect()}[last]
    assert (z is not None) is scored
    if scored and value == 5:
        assert abs(z) < 0.2
    assert (D.baseline_anomaly(df, "host", 100, 10_000, 5, 3.0, last + 100).count() == 1) is fires


def test_rule_tolerance_and_failures(spark):
    df = spark.createDataFrame([(1.0 + 1e-12,), (None,)], "v double")
    assert [r[0] for r in df.select(D.compare(F.col("v"), "==", 1.0)).collect()] == [True, None]
    alerts = spark.createDataFrame([("a", "new", 1, 1), ("b", "new", 1, 1), ("c", "ack", 1, 1), ("d", "closed", 1, 1)], "dedup string, status string, ts long, last_ts long")
    results = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("d", True), ("e", True), ("f", False)], "dedup string, fired boolean")
    got = sorted((r["dedup"], r["status"], r["ts"], r["last_ts"]) for r in D.merge_alerts(alerts, results, 9).collect())
    # an open alert's time moves on; a closed one stays beside the new one of its key
    assert got == [("a", "new", 9, 9), ("b", "resolved", 1, 1), ("c", "ack", 1, 1), ("d", "closed", 1, 1), ("d", "new", 9, 9), ("e", "new", 9, 9)]


def test_blind_rules(spark):
    h = [("a", t, False, 1800, "timeout") for t in (10, 20, 30)] + [("a", 5, True, 1800, "")] + [("b", 10, False, 1800, "x"), ("b", 20, True, 1800, "")] + [("c", t, False, 600, "y") for t in (1, 2, 3)]
    got = D.blind_rules(spark.createDataFrame(h, "rule string, ts long, ok boolean, interval_s int, cause string")).collect()
    assert [(r["rule"], r["failed"], r["since"]) for r in got] == [("a", 3, 10)]


def test_fire_units(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    assert D.fire_units(df, True).count() == 3 and D.fire_units(df, False).count() == 1
    assert sorted(str(r[0]) for r in D.fire_units(df, True, "k").collect()) == ["None", "a"]
    assert D.fire_units(df.where("false"), False).count() == 0


@pytest.mark.parametrize("topn", [0, 1, 3, 50])
@pytest.mark.parametrize("cardinality", [1, 5, 60])
def test_cap_accounts_for_everything(spark, topn, cardinality):
    df = spark.createDataFrame([(i, 3600 * (i % 2), "s", f"v{i:03}") for i in range(2 * cardinality)], "id long, ts long, source string, host string")
    r = R.dim_rollup(df, [("s", "host")], topn)
    got = R.cap_report(r).first()
    left = 2 * max(0, cardinality - topn) if topn else 0
    assert (got["served"], got["dropped"], got["known"]) == (2 * cardinality - left, left, 2)
    assert got["state"] == ("capped" if left else "complete")
    assert R.cap_report(r.where("dim <> '!dim'")).first()["state"] == "unknown"


@pytest.mark.parametrize("start,end", [(0, 100_000), (3600, 7199), (3601, 7199), (10, 20), (7200, 7200), (0, 3599), (5000, 30_001)])
def test_rollup_reads_match_raw(spark, start, end):
    rows = [(i, i * 733 % 40_000, ["a", "b"][i % 2], i % 4, "x", "h", "1", None) for i in range(300)] + [(900 + i, 3600 * i, "a", 3, "x", "h", "1", None) for i in range(11)]
    df = spark.createDataFrame(rows, EV)
    watermark, covered = 28_800, 250
    rolled = R.event_rollup(df.where((F.col("ts") < watermark) & (F.col("id") <= covered)))
    got = {(r[0], r[1]): r[2] for r in R.merge_rollup_raw(rolled, df, ["source", "severity"], start, end, watermark, covered).collect()}
    want = {(r[0], r[1]): r[2] for r in df.where(F.col("ts").between(start, end)).groupBy("source", "severity").count().collect()}
    assert got == want


def test_bands():
    assert R.missing_bands([(10, 20), (30, 40)], 0, 50) == [(0, 10), (20, 30), (40, 50)]
    assert R.missing_bands([(0, 50)], 10, 20) == [] and R.missing_bands([], 1, 2) == [(1, 2)]


def test_metric_rollup(spark):
    df = spark.createDataFrame([(1000 + i, "m", "{}", "h", float(i)) for i in range(5)] + [(900_000, "m", "{}", "h", 1.0)] * 2, "ts long, name string, labels string, host string, value double")
    rolled, raw = R.metric_rollup(df, 800_000)
    assert [(r["n"], r["avg"], r["max"]) for r in rolled.collect()] == [(5, 2.0, 4.0)] and raw.count() == 2


def test_masks(spark):
    rules = [{"field": "host", "mask": "partial"}, {"field": "host", "mask": "clear", "role": "admin"}, {"field": "user", "mask": "redact"}, {"field": "src_ip", "mask": "deny"}, {"field": "src_ip", "mask": "clear", "role": "admin"}]
    known = {"admin", "analyst"}
    assert G.resolve_masks(rules, "admin", "t", "e", known) == {"user": "redact", "src_ip": "deny"}
    assert G.resolve_masks(rules, None, "t", "e", known) == {"host": "partial", "user": "redact", "src_ip": "deny"}
    df = spark.createDataFrame([(1, "host-1234", "1.1.1.1", '{"user":"bob","k":"1"}'), (2, None, None, None)], "id long, host string, src_ip string, fields string")
    a, b = G.apply_masks(df, G.resolve_masks(rules, "analyst", "t", "e", known)).collect()
    assert (a["host"], a["src_ip"], a["fields"]) == ("***1234", None, '{"k":"1"}') and b["host"] is None
    with pytest.raises(PermissionError):
        G.check_references({"host"}, {"host": "mask"})


def test_retention_and_holds(spark):
    day = 86400
    df = spark.createDataFrame([(i, (100 - i) * day, "s", 0, "x", "h", "1", None, e) for i in range(60) for e in ("prod", "lab")], EV + ", env_id string")
    holds = spark.createDataFrame([("s", 50 * day, 51 * day, True)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    got = G.retain(df, {"lab": 1}, 30, holds, 100 * day).groupBy("env_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"lab": 8 + 2, "prod": 31 + 2}
    assert G.retain(df, {}, 30, None, 100 * day).count() == 120 and G.legal_hold_filter(df, None).count() == 0
    assert sorted(r["id"] for r in G.cap_rows(df.where("env_id = 'lab'"), 3).collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in G.cap_bytes(df.where("env_id = 'lab'"), 25, F.lit(10)).collect()) == [0, 1]


def test_purge(spark):
    df = spark.createDataFrame([(i, i * 10, "s", 0, "x", f"h{i % 2}", "1", None) for i in range(20)], EV)
    for bad in ({"start": 0, "end": 5}, {"host": "h1", "start": 9, "end": 1}, {"host": "h1"}):
        with pytest.raises(ValueError):
            G.purge_plan(df, bad)
    scope = {"host": "h1", "start": 0, "end": 100}
    plan = G.purge_plan(df, scope)
    assert [(r["n"], r["min_id"], r["max_id"]) for r in plan.collect()] == [(5, 1, 9)]
    digest = tuple(G.plan_digest(plan).first())
    holds = spark.createDataFrame([("s", 85, None, True)], "scope_source string, scope_start_ts long, scope_end_ts long, active boolean")
    stay, hours = G.purge_apply(df, scope, digest, holds)
    assert stay.count() == 16 and [r[0] for r in hours.collect()] == [0]
    with pytest.raises(RuntimeError):
        G.purge_apply(df.where("id <> 3"), scope, digest, holds)


def test_purge_sample(spark):
    """The five oldest and newest rows of the scope by (ts, id), with their sources."""
    rows = [(i, 10 * (i // 3), None if i % 5 == 0 else "often", 0, "x", "h1", "1", None) for i in range(1, 60)] + [(99, 100, "rare", 0, "x", "h1", "1", None)]
    plan = G.purge_plan(spark.createDataFrame(rows, EV).repartition(5), {"host": "h1", "start": 0, "end": 150})
    inside = sorted((r[1], r[0], r[2]) for r in rows if r[1] <= 150)
    ends = inside[:5] + inside[-5:]
    assert {r["source"]: r["samples"] for r in plan.collect()} == {s: [i for _, i, x in ends if x == s] for s in (None, "often", "rare")}
    few = G.purge_plan(spark.createDataFrame(rows, EV), {"host": "h1", "start": 100, "end": 100}).collect()
    assert {r["source"]: r["samples"] for r in few} == {None: [30], "often": [31, 32], "rare": [99]}


def test_chain(spark):
    import hashlib

    rows, prev = [], ""
    for i in range(1, 30):
        h = hashlib.sha256(f"{prev}|{i}|k|d{i}".encode()).hexdigest()
        rows.append((i * 9_001, i, "k", f"d{i}", prev, h))
        prev = h
    df = spark.createDataFrame(rows, "id long, ts long, kind string, detail string, prev_hash string, hash string")
    assert G.verify_chain(df).first()[0] is None
    assert G.verify_chain(df.withColumn("detail", F.when(F.col("ts") == 7, "x").otherwise(F.col("detail")))).first()[0] == 7 * 9_001
    assert G.verify_chain(df.where("ts <> 12")).first()[0] == 13 * 9_001


def test_risk(spark):
    c = spark.createDataFrame([("ip", "a", 90_000, 60, "r", 3, "T1110.001"), ("ip", "a", 99_000, 50, "r", 4, "T1046"), ("ip", "b", 1, 500, "r", 4, "T1046"), ("ip", "c", 99_999, 60, "r", 1, "")], "entity_type string, entity string, ts long, risk_score int, rule string, severity int, mitre string")
    tactics = spark.createDataFrame([("T1110", "x"), ("T1046", "y")], "technique string, tactic string")
    got = {r["entity"]: r for r in K.risk_incidents(K.risk_rollup(c, tactics, 100_000)).collect()}
    assert set(got) == {"a", "c"} and got["a"]["score"] == 110 and got["a"]["n_tactics"] == 2 and got["a"]["reasons"] == "score 110; velocity 50"
    assert (got["a"]["severity"], got["c"]["severity"], got["c"]["reasons"]) == (3, 2, "velocity 60")


def test_sigma_forms(spark):
    df = spark.createDataFrame([(1, "exec", '{"cmdline":"whoami /all","image":"C:\\\\\\\\x.exe"}', "a"), (2, "process", '{"cmdline":"ls"}', "b"), (3, "web", '{"cmdline":"whoami"}', "c"), (4, "exec", None, "d whoami")], "id long, category string, fields string, message string")
    rule = {"logsource": {"category": "process_creation"}, "detection": {"s": {"CommandLine|contains|all": ["who", "/a"]}, "k": ["whoami"], "f": {"CommandLine": "ls*"}, "condition": "s or (k and not f) or f"}}
    assert sorted(r["id"] for r in df.where(S.sigma_predicate(rule, df.columns)).collect()) == [1, 2, 4]
    assert S.sigma_fields(rule) == {"cmdline"} and S.sigma_severity({"level": "critical"}) == 4 and S.sigma_techniques({"tags": ["attack.t1059.004", "attack.execution"]}) == ["T1059.004"]
    with pytest.raises(ValueError):
        S.sigma_predicate({"detection": {"a": {"x": 1}, "condition": "all of z*"}}, [])


@pytest.mark.parametrize(
    "condition,want",
    [
        ("not sel_a and sel_b or other", lambda a, b, c: (not a and b) or c),
        ("sel_a or sel_b and not other", lambda a, b, c: a or (b and not c)),
        ("not (sel_a or sel_b)", lambda a, b, c: not (a or b)),
        ("1 of sel_* and not other", lambda a, b, c: (a or b) and not c),
        ("NOT All OF sel_*", lambda a, b, c: not (a and b)),
        ("all of them", lambda a, b, c: a and b and c),
        ("any of them", lambda a, b, c: a or b or c),
    ],
)
def test_sigma_conditions(spark, condition, want):
    rows = [(i, "x", "".join(w for k, w in enumerate(("aa", "bb", "cc")) if i >> k & 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, category string, message string")
    rule = {"detection": {"sel_a": ["aa"], "sel_b": ["bb"], "other": ["cc"], "condition": condition}}
    assert [r["id"] for r in df.where(S.sigma_predicate(rule, df.columns)).orderBy("id").collect()] == [i for i in range(8) if want(i & 1, i & 2, i & 4)]


@pytest.mark.parametrize("condition", ["a and", "a a", "()", "(a)(a)", "", "b", "a | count() > 5", "__import__", "1 of b*", "not"])
def test_sigma_conditions_that_are_none(spark, condition):
    with pytest.raises(ValueError):
        S.sigma_predicate({"detection": {"a": ["x"], "condition": condition}}, [])


def test_columns_named_like_internals(spark):
    """A caller's columns keep their values, whatever they are called."""
    rows = [(i, 1000 * i, f"h{i % 3}", f"d{i % 4}" if i % 5 else None, None if i % 7 else "lab", i, -i, i * 2, f"r{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts long, host string, dedup string, env_id string, _n long, _hour long, _before long, _N_ string")
    whole = {r["id"]: r for r in df.collect()}
    for out in (dedup_events(df), sample_every_n(df, 3, "dedup"), G.cap_rows(df, 5), G.cap_bytes(df, 60, F.lit(10)), Search(df).dedup("dedup").df):
        got = out.collect()
        assert out.columns == df.columns and 0 < len(got) < 40 and all(r == whole[r["id"]] for r in got)
    seen, want = {}, []
    for r in rows:
        seen[r[3]] = seen.get(r[3], 0) + 1
        if seen[r[3]] % 3 == 1:
            want.append(r[0])
    assert sorted(r["id"] for r in sample_every_n(df, 3, "dedup").collect()) == want
    newest = {e: sorted((r[0] for r in rows if r[4] == e), reverse=True)[:6] for e in (None, "lab")}
    assert sorted(r["id"] for r in G.cap_bytes(df, 60, F.lit(10)).collect()) == sorted(newest[None] + newest["lab"])


def test_iocs_first_hit(spark):
    df = spark.createDataFrame([(1, None, "9.9.9.9", None, '{"md5":"AA"}'), (2, " 1.1.1.1", "9.9.9.9", None, None), (3, None, None, None, None)], "id long, src_ip string, dst_ip string, url string, fields string")
    iocs = spark.createDataFrame([("ip", "9.9.9.9", "f", 10, 1, 0), ("hash", "aa", "f", 20, 2, 0), ("ip", "1.1.1.1", "f", 30, 3, 5), ("ip", "1.1.1.1", "g", 40, 3, 500)], "type string, value string, source string, confidence int, severity int, expires long")
    got = {r["id"]: (r["ti_match"], r["ti_confidence"], r["threat_intel"]) for r in match_iocs(df, iocs, 100).collect()}
    assert got == {1: ("9.9.9.9", 10, True), 2: ("1.1.1.1", 40, True), 3: (None, None, False)}
    assert sorted(r["id"] for r in sample_every_n(df.withColumn("ts", F.col("id")), 2, "url").collect()) == [1, 3]


def test_silent_hosts_and_routing(spark):
    h = spark.createDataFrame([("a", "prod", 100, 1, 5, 1), ("b", "prod", 9_000, 1, 5, 1), ("c", "prod", 50, 1, 5, 1)], "host string, env_id string, last_ts long, first_ts long, sig_total long, sig_hot long")
    got = N.silent_fleet(h, 10_000).first()
    assert (got["expected"], got["silent"], got["worst"]) == (3, 2, ["c", "a"])
    assert got["fingerprint"] == N.silent_fleet(h.where("host <> 'b'"), 10_000).first()["fingerprint"] != N.silent_fleet(h, 5_000_000).first()["fingerprint"]
    assert N.alert_groups(spark.createDataFrame([(1, 1, None, 2, "new", "t"), (2, 2, "", 3, "closed", "u")], "id long, ts long, host string, severity int, status string, title string"), "host").collect()[0]["n"] == 2


def test_alert_groups_take_the_smallest_id_of_the_newest_second(spark):
    data = [(3, 9, "h", 2, "new", "c"), (1, 5, "h", 2, "new", "a"), (2, 9, "h", 2, "new", "b")]
    got = N.alert_groups(spark.createDataFrame(data, "id long, ts long, host string, severity int, status string, title string"), "host").collect()
    assert [(r["title"], r["last_id"], r["n"]) for r in got] == [("b", 2, 3)]


def test_absent_fields_and_inequality_in_the_library(spark):
    from secspark.operators.rules import evaluate_library

    name, bag = "ex-egress-fanout-external", '{"dir":"outbound","scope":"external","dst_ip":"%d"%s}'
    fired = lambda more, **kw: evaluate_library(spark.createDataFrame([(i, 1000, "conntrack", bag % (i, more)) for i in range(60)], "id long, ts long, source string, fields string"), 1000, [name], **kw).first()["fired"]
    assert not fired("") and fired("", absent_differs=True)
    assert all(fired(',"proc":"curl"', absent_differs=x) and not fired(',"proc":"containerd"', absent_differs=x) for x in (True, False))
