"""Alert routing by counting labels, against a scan of every policy."""

import random

import pytest

from secspark.operators.detect import LABELS, route_alerts
from secspark.operators.sigma import sigma_predicate

ALERTS = "id long, rule string, host string, mitre string, src_ip string, severity int"
POLICIES = "id long, match map<string,string>, channels array<string>, continue boolean"
SILENCES = "match map<string,string>, until long"


def brute(alerts, policies, silences, now, channels):
    out = []
    for i, *own in alerts:
        labels = {k: str(v) for k, v in zip(LABELS, own) if v is not None}
        holds = lambda m: all(labels.get(k) == v for k, v in m.items())
        got, found = [], sorted((p for p in policies if holds(p[1])), key=lambda p: (-len(p[1]), p[0] is not None, p[0] or 0, p[2], bool(p[3])))
        for p in found:
            got += p[2]
            if not p[3]:
                break
        out.append((i, sorted(set(got)) if found else sorted(channels), any(holds(m) and until > now for m, until in silences)))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_routes(spark, seed):
    r = random.Random(seed)
    value = {"rule": ["a", "b", ""], "host": ["h1", "h2", None], "mitre": ["T1", None], "src_ip": ["1", "2"], "severity": ["1", "3", None]}
    alerts = [(r.choice([None, i, 5]), r.choice(["a", "b", "", None]), r.choice(["h1", "h2", None]), r.choice(["T1", None]), r.choice(["1", "2", None]), r.choice([1, 3, None])) for i in range(60)]
    policies = [(i, {k: r.choice(value[k]) for k in r.sample(LABELS, r.randint(0, 3))}, r.sample(["mail", "page", "web", "sms"], r.randint(0, 2)), r.choice([True, False, None])) for i in range(14)]
    policies += [(99, {"other": "x"}, ["never"], False), (98, {}, ["all"], True)] if seed > 1 else [(None, {"host": "h1", "other": None}, ["odd"], True)]
    silences = [({k: r.choice(value[k]) for k in r.sample(LABELS, 2)}, r.choice([5, 50])) for _ in range(4)] + ([({}, 5)] if seed == 2 else [])
    args = (spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(policies, POLICIES), spark.createDataFrame(silences, SILENCES))
    got = route_alerts(*args, 10, ["web", "mail"])
    assert sorted(map(str, map(tuple, got.collect()))) == brute(alerts, policies, silences, 10, ["web", "mail"])


def test_no_policies_and_no_alerts(spark):
    none = spark.createDataFrame([], POLICIES), spark.createDataFrame([], SILENCES)
    one = spark.createDataFrame([(None, "a", None, None, None, None)] * 2, ALERTS)
    assert [tuple(x) for x in route_alerts(one, *none, 1, ["b", "a"]).collect()] == [(None, ["a", "b"], False)] * 2
    assert route_alerts(one.limit(0), *none, 1, ["a"]).count() == 0


def test_many_policies_without_a_nested_loop(spark):
    policies = spark.range(100_000).selectExpr("id", "map('host', concat('h', id)) AS match", "array('x') AS channels", "false AS `continue`")
    silences = spark.range(100_000).selectExpr("map('src_ip', cast(id AS string)) AS match", "9L AS until")
    alerts = spark.createDataFrame([(1, "r", "h7", None, "12", 2), (2, "r", "other", None, "none", 2)], ALERTS)
    out = route_alerts(alerts, policies, silences, 1, ["all"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, ["x"], True), (2, ["all"], False)]


@pytest.mark.parametrize("condition", ["not " * 200_000 + "a", "(" * 3000 + "a" + ")" * 3000, "a " + "and a " * 5000, "a and", "and a", "a b", "( a", "a )", "()", "not", "a or or a", "__import__('os')", ""])
def test_long_and_broken_conditions_are_refused(condition, spark):
    with pytest.raises(ValueError):
        sigma_predicate({"detection": {"a": ["x"], "condition": condition}}, [])
