"""Enrichment that leaves rows without a match where they are."""

import random

import pytest
from pyspark.sql import functions as F

from secspark.operators import normalize as N

EVENTS = "id long, ts long, src_ip string, dst_ip string, url string, fields string, category string, severity int, key string, bits string, hit string, probe string"


def events(spark, seed=1, n=150):
    r = random.Random(seed)
    ip = lambda: r.choice([None, "", "10.0.0.1", " 10.0.0.2 ", "10.0.1.7", "10.1.2.3", "bad", "10.0.0.1"])
    bag = lambda: r.choice([None, "{", "{}", '{"domain":"Evil.ORG"}', '{"md5":"aa","domain":"x"}', '{"domain":"x","domain":"evil.org"}', '{"path":"/etc/a.service","hash":"h1"}', '{"path":"a.service","hash":"h2"}', '{"path":"/b"}'])
    rows = [(r.choice([None, i, 7]), r.choice([None, 86400 * r.randint(0, 5) + r.randint(0, 9)]), ip(), ip(), r.choice([None, "http://e.org/x"]), bag(), r.choice(["integrity", "x", None]), r.choice([None, 0, 1, 2, 3]), "k", "b", "h", "p") for i in range(n)]
    return rows + rows[:5], spark.createDataFrame(rows + rows[:5], EVENTS)


def as_set(rows):
    return sorted(map(str, rows))


def test_iocs(spark):
    import json

    rows, df = events(spark)
    feed = [("ip", "10.0.0.2", "f", 90, 3, 0), ("ip", "10.0.0.2", "g", 50, 1, 0), ("d", " EVIL.org", "f", 10, 2, 100), ("h", "AA", "f", None, None, None), ("ip", "10.1.2.3", "old", 99, 3, 5), ("x", "", "f", 1, 1, 0), ("x", None, "f", 1, 1, 0)]
    got = N.match_iocs(df, spark.createDataFrame(feed, "type string, value string, source string, confidence int, severity int, expires long"), 10)
    live = {"10.0.0.2": (90, 3), "evil.org": (10, 2), "aa": (0, 0)}

    def want(x):
        # of a repeated key the first counts here, as it does in the JSON path function
        try:
            f = json.loads(x[5] or "{}", object_pairs_hook=lambda p: dict(reversed(p)))
        except ValueError:
            f = {}
        for v in [x[2], x[3], x[4], *[f.get(k) for k in N.IOC_FIELDS]]:
            k = (v or "").strip().lower()
            if k in live:
                return (*x, k, *live[k], True)
        return (*x, None, None, None, False)

    assert got.columns == df.columns + ["ti_match", "ti_confidence", "ti_severity", "threat_intel"]
    assert as_set(map(tuple, got.collect())) == as_set(map(want, rows))
    none = N.match_iocs(df, spark.createDataFrame([], "type string, value string, source string, confidence int, severity int, expires long"), 10)
    assert none.where("threat_intel").count() == 0 and none.count() == len(rows)


def test_scopes(spark):
    rows, df = events(spark, 2)
    scopes = [("d", "10.0.", True, 0, 10**9), ("c", "10.0.0.1", False, 86400, 86400 * 3), ("b", "10.0.1", True, 0, 86400 * 2), ("a", "1", True, 86400 * 4, 86400 * 5), ("e", "10.1.2.3", True, 0, 10**9), ("0", "10.0.0.1", False, 9, 3)]
    got = N.tag_scope(df, spark.createDataFrame(scopes, "id string, matcher string, is_prefix boolean, window_start long, window_end long"))

    def want(x):
        hits = [s[0] for s in scopes if x[1] is not None and x[2] is not None and s[3] <= x[1] <= s[4] and (x[2].startswith(s[1]) if s[2] else x[2] == s[1])]
        return (*x, min(hits, default=None))

    assert as_set(map(tuple, got.collect())) == as_set(map(want, rows))
    again = N.tag_scope(got, spark.createDataFrame([], "id string, matcher string, is_prefix boolean, window_start long, window_end long"))
    assert as_set(map(tuple, again.collect())) == as_set(map(want, rows))


def test_relabel(spark):
    rows, df = events(spark, 3)
    deploys = [("a.service", "h1", 0), ("a.service", "h1", 86400), ("a.service", "h2", 86400 * 3), (None, "h1", 0), ("b", None, 0)]
    got = N.relabel_corroborated(df, spark.createDataFrame(deploys, "name string, hash string, deployed_at long"), 5, 1)
    assert got.columns == df.columns
    hit = {("a.service", "h1"): [0, 86400], ("a.service", "h2"): [86400 * 3]}

    def lowered(x):
        if x[6] != "integrity" or x[7] is None or x[7] <= 1 or x[1] is None or x[5] is None or "hash" not in x[5]:
            return False
        return any(t <= x[1] <= t + 5 for t in hit.get(("a.service", "h1" if "h1" in x[5] else "h2"), []))

    plain = [x for x in rows if not lowered(x)]
    out = list(map(tuple, got.collect()))
    assert len(out) == len(rows) and as_set(x for x in out if "severity_original" not in str(x[5])) == as_set(plain)
    assert all(x[7] == 1 for x in out if "severity_original" in str(x[5]))


@pytest.mark.parametrize("kind", ["iocs", "scopes", "deploys"])
def test_rows_without_a_candidate_are_not_shuffled(spark, kind):
    """Each exchange is below a join of distinct values, or of rows that passed the filter; large tables need no nested loop."""
    _, df = events(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if kind == "iocs":
            feed = spark.range(100_000).selectExpr("'ip' AS type", "concat('10.9.', id) AS value", "'f' AS source", "1 AS confidence", "1 AS severity", "0L AS expires")
            out = N.match_iocs(df, feed, 1)
        elif kind == "scopes":
            out = N.tag_scope(df, spark.range(100_000).selectExpr("cast(id AS string) AS id", "concat('10.', id % 250, '.') AS matcher", "true AS is_prefix", "id AS window_start", "id + 99999 AS window_end"))
        else:
            out = N.relabel_corroborated(df, spark.range(100_000).selectExpr("cast(id AS string) AS name", "'h' AS hash", "id AS deployed_at"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.lstrip().startswith(("Project", "Union")) and "Union" in plan
    loops = [x for x in physical.splitlines() if "NestedLoop" in x or "Cartesian" in x]
    assert all("BuildRight, Inner" in x or "BuildRight, Cross" in x for x in loops) and len(loops) <= 4  # only with the one row of the filter
    # the branch of rows without a candidate: no exchange between the scan and the union but the broadcast of the filter
    branch = physical.split("Union")[1].split("\n")
    first = []
    for line in branch[1:]:
        if line.strip().startswith("+- ") and first and line.index("+-") <= branch[1].index(":-") if ":-" in branch[1] else False:
            break
        first.append(line)
        if "Scan" in line or "LocalTableScan" in line:
            break
    assert not any("Exchange hashpartitioning" in x for x in first)
    assert out.where("1 = 1").count() == df.count()


def test_filter_has_every_key(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    words = N.key_filter(keys, 1 << 12)
    assert len(words.first()["bits"]) == 64
    for bits in (1 << 12, 1 << 18):
        found = keys.union(spark.range(5000).selectExpr("concat('other', id)")).crossJoin(N.key_filter(keys, bits)).select("key", N._may_be(F.col("key"), F.col("bits"), bits).alias("may"))
        assert found.where("key like 'k%' and not may").count() == 0
    assert found.where("key like 'other%' and may").count() < 100


def test_reparse_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([(1, None, "s", "a=1", None), (2, 50, "s", "a=2", None), (3, 1, "s", "a=3", None)], "id long, ts long, source string, message string, fields string")
    out = {r["id"]: r["fields"] for r in N.reparse(df, [("s", r"a=(?<a>\d)")], 10).collect()}
    assert out == {1: None, 2: '{"a":"2"}', 3: None}


def test_key_values_run_their_pattern_once(spark):
    df = spark.createDataFrame([('a=1 b="x \\" y" a=2, c=d=e;f= "g" h="" =i j',), (None,), ("",)], "m string").select(N.key_values(F.col("m")).alias("kv"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    got = df.collect()
    assert got[0]["kv"] == {"a": "1", "b": 'x \\" y', "c": "d=e", "h": ""} and got[1]["kv"] == {} and got[2]["kv"] == {}


def test_the_filter_is_small_enough_to_go_with_each_row():
    assert N.FILTER_BITS // 8 <= 1 << 16
