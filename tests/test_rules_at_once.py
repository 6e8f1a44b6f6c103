"""Many rules in one scan against one search each; distinct counts from sketches."""

import random

import pytest
from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.operators import rollups as RU
from secspark.operators.detect import Rule, evaluate_at_once, evaluate_rules
from secspark.operators.search import Search

NOW = 10_000


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, r.randint(NOW - 4000, NOW + 50)]), r.choice(["a", "b", "c", None]), r.choice(["x", "y", None]), r.choice([None, 1.5, 2.0, 7.0]), f"h{r.randint(0, 9)}") for i in range(400)]
    return spark.createDataFrame(rows, "id long, ts long, source string, action string, value double, host string")


def one(df, r):
    """The value by a search of its own."""
    found = r.query(Search(df).search(start=NOW - r.window_s, end=NOW)).df
    rows = found.limit(1).collect()
    return None if not rows or rows[0][-1] is None else float(rows[0][-1])


def rules():
    is_ = lambda c, v: P.eq(F.col(c), v)
    return [
        Rule("n", lambda s: s.search(is_("source", "a")).stats("count"), ">", 3, under=("source", "a")),
        Rule("n0", lambda s: s.search(is_("source", "zz")).stats("count"), "==", 0, under=("source", "zz")),
        Rule("dc", lambda s: s.search(is_("source", "b")).where(is_("action", "x")).stats(("dc", "host")), ">=", 2, 900, under=("source", "b")),
        Rule("c", lambda s: s.search().stats(("count", "action")), "<", 5),
        Rule("sum", lambda s: s.where(is_("action", "y")).stats(("sum", "value")), "<=", 1e9, 2000, under=("action", "y")),
        Rule("none", lambda s: s.where(is_("action", "zz")).stats(("sum", "value")), ">", 0),
        Rule("avg", lambda s: s.stats(("avg", "value")), "!=", 0),
        Rule("min", lambda s: s.where(F.col("value") > 1.9).stats(("min", "value")), "==", 2.0, under=None),
        Rule("max", lambda s: s.stats(("max", "value")), ">", 6, 100),
        Rule("text", lambda s: s.stats(("max", "host")), ">", 6),  # text: by a search of its own
        Rule("top", lambda s: s.stats("count", by=["host"]).sort("-count", "host").head(1), ">", 6),
        Rule("having", lambda s: s.stats("count", by=["host"]).where(F.col("count") > 20).stats("count"), ">", 0),
        Rule("off", lambda s: s.stats("count"), ">", 0, enabled=False),
    ]


def test_same_values(spark, events):
    got = {r["rule"]: (r["value"], r["fired"]) for r in evaluate_rules(events, rules(), NOW).collect()}
    assert set(got) == {r.name for r in rules() if r.enabled}
    for r in rules():
        if r.enabled:
            want = one(events, r) if r.name != "text" else None
            assert got[r.name][0] == want, r.name
            test = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "==": lambda v, t: abs(v - t) < 1e-9, "!=": lambda v, t: abs(v - t) >= 1e-9}[r.op]
            assert got[r.name][1] == (want is not None and test(want, r.threshold)), r.name
    _, rest = evaluate_at_once(events, rules(), NOW)
    assert {r.name for r in rest} == {"text", "top", "having"}


def test_a_thousand_rules_in_one_scan(spark, events):
    many = [Rule(f"r{i}", lambda s, i=i: s.search(P.eq(F.col("host"), f"h{i % 20}"), F.col("id") > i % 300).stats("count"), ">", 0, 3000, under=("host", f"h{i % 20}")) for i in range(1000)]
    out = evaluate_rules(events, many, NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[id") + plan.count("LocalTableScan [id") <= 1
    got = {r["rule"]: r["value"] for r in out.collect()}
    rows = [r for r in events.collect() if r["ts"] is not None and NOW - 3000 <= r["ts"] <= NOW]
    assert got == {f"r{i}": float(sum(r["host"] == f"h{i % 20}" and r["id"] > i % 300 for r in rows)) for i in range(1000)}


def test_no_rules(spark, events):
    assert evaluate_rules(events, [], NOW).count() == 0


def test_sketches_merge(spark):
    df = spark.range(60_000).selectExpr("id % 50000 AS v", "id % 7 * 3600 AS ts", "id % 3 AS k")
    rolled = RU.sketch_rollup(df, "v", ["k"])
    dc = RU.distinct_from_sketches(rolled, []).first()["dc"]
    assert abs(dc - 50_000) < 50_000 * 0.05
    some = RU.distinct_from_sketches(rolled, ["k"], 3600, 7200)
    exact = {r["k"]: r["n"] for r in df.where("ts = 3600").groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    assert all(abs(r["dc"] - exact[r["k"]]) < exact[r["k"]] * 0.05 for r in some.collect())
    nulls = spark.createDataFrame([(None, 5)], "v string, ts long")
    assert RU.distinct_from_sketches(RU.sketch_rollup(nulls, "v", []), []).first()["dc"] == 0
