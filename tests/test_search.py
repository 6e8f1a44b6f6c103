"""Search, functions and predicates: hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.functions import scalar as S
from secspark.operators.search import Search, pages, search_bar

EV = "id long, ts long, source string, host string, severity int, message string, fields string, src_ip string"


def events(spark, rows):
    return spark.createDataFrame([(i, ts, "s", "h", sev, m, f, None) for i, (ts, sev, m, f) in enumerate(rows)], EV)


def ts(s):
    return [r["ts"] for r in s.df.select("ts").collect()]


def test_bounds(spark):
    s = Search(events(spark, [(t, 0, "m", None) for t in (100, 200, 300, 400, 500)]))
    assert sorted(ts(s.search(start=200, end=400))) == [200, 300, 400]
    assert len(ts(s.search())) == 5
    assert sorted(ts(s.search(start=250))) == [300, 400, 500]


def test_regex(spark):
    s = Search(events(spark, [(100, 0, "login failed", None), (200, 0, "login ok", None), (300, 0, "LOGIN FAILED", None), (400, 0, "sudo cmd", None)]))
    assert sorted(ts(s.search(P.regex(F.col("message"), "(?i)^login failed$")))) == [100, 300]
    with pytest.raises(ValueError):
        P.regex(F.col("message"), "x" * 513)


def test_json_fields(spark):
    s = Search(events(spark, [(100, 0, "", '{"user":"alice"}'), (200, 0, "", '{"user":"bob"}'), (300, 0, "", None)]))
    user = F.get_json_object("fields", "$.user")
    assert ts(s.search(P.eq(user, "alice"))) == [100] == ts(s.search(P.regex(user, "^al")))
    assert ts(s.search(P.ne(user, "alice"))) == [200]
    assert ts(s.search(~P.regex(user, "^al"))) == [200, 300]


def test_free_text(spark):
    s = Search(events(spark, [(1, 0, "Alpha one", None), (2, 0, "beta two 100%", None)]))
    assert ts(s.search(P.free_text("alpha"))) == [1] and len(ts(s.search(P.free_text("*")))) == 2
    assert ts(s.search(P.free_text("0%"))) == [2] and ts(s.search(P.free_text("a%n"))) == []


def test_combination(spark):
    rows = [(100, 4, "alert a", None), (200, 1, "alert b", None), (250, 3, "alert c", None), (300, 3, "alert d", None), (350, 3, "quiet", None), (450, 4, "alert e", None)]
    got = Search(events(spark, rows)).search(start=150, end=400).where(F.col("severity") >= 3).where(P.regex(F.col("message"), "alert")).sort("-ts")
    assert ts(got) == [300, 250]
    assert [n for n, _ in got.stages] == ["search", "where", "where", "sort"]


def test_keyset_pages(spark):
    rows = [(1000 + k, 0, "m", None) for k in range(7) for _ in range(5)] + [(2000 + k, 0, "m", None) for k in range(3)]
    got = [[(r["ts"], r["id"]) for r in page] for page, _ in pages(Search(events(spark, rows)), 8)]
    flat = [x for p in got for x in p]
    assert len(flat) == 38 == len(set(flat)) and flat == sorted(flat, reverse=True) and len(got) == 5


def test_search_bar(spark):
    df = events(spark, [(1, 3, "Disk full on node", '{"unit":"disk.service"}'), (2, 1, "all fine", '{"unit":"full disk"}')])
    assert [r["id"] for r in search_bar(df, "disk sev>=high").collect()] == [0]
    assert [r["id"] for r in search_bar(df, "disk", values=True).collect()] == [1, 0]
    assert [r["id"] for r in search_bar(df, "~fine$ sev:low").collect()] == [1]


def test_nulls_in_aggregates(spark):
    df = spark.createDataFrame([(1, 10, "a", 1), (2, 11, None, 5), (3, 12, "a", None)], "id long, ts long, k string, v int")
    got = {r["k"]: tuple(r)[1:] for r in Search(df).stats("count", ("sum", "v"), ("list", "v"), ("values", "v"), by=["k"]).df.collect()}
    assert got == {"a": (2, 1, [1], [1]), None: (1, 5, [5], [5])}
    rows = Search(df).eventstats("count", by=["k"]).df.collect()
    assert {r["id"]: r["count"] for r in rows} == {1: 2, 2: 1, 3: 2}
    assert [r["k"] for r in Search(df).mvexpand("k").df.orderBy("id").collect()] == ["a", None, "a"]
    assert Search(df.where("false")).top("k").df.count() == 0 and Search(df.where("false")).stats("count").df.first()[0] == 0


def test_functions(spark):
    df = spark.createDataFrame([(1, None), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(S.min_(F.col("a"), F.col("b"))).collect()] == [None, 2]
    assert [r[0] for r in df.select(S.if_(F.col("b") > 1, "y", "n")).collect()] == ["n", "y"]
    times = spark.createDataFrame([("2024-01-10T00:00:00Z",), ("bad",), (None,)], "s string")
    assert [r[0] for r in times.select(S.iso_epoch(F.col("s"))).collect()] == [1704844800, None, None]
    epochs = spark.createDataFrame([("1704844800",), ("1704844800123",), ("1704844800123456789",), ("-1",), ("x",)], "s string")
    assert [r[0] for r in epochs.select(S.epoch(F.col("s"))).collect()] == [1704844800] * 3 + [None, None]
    tags = spark.createDataFrame([("T1059.001, T1078",), ("odd",), (None,)], "m string")
    assert [r[0] for r in tags.select(F.transform(S.techniques(F.col("m")), S.parent_technique)).collect()] == [["T1059", "T1078"], ["odd"], []]
    pairs = spark.createDataFrame([("cis:1.1; pci",)], "c string").select(S.compliance_pairs(F.col("c"))).first()[0]
    assert [tuple(p) for p in pairs] == [("cis", "1.1"), ("pci", None)]


def test_networks(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("10.1.20.3",), (None,), ("text",)], "ip string")
    got = lambda n, m: [bool(r[0]) for r in df.select(F.coalesce(P.in_network(F.col("ip"), n, m), F.lit(False))).collect()]
    assert got("10.1.0.0/20", "prefix") == [True, True, False, False]
    assert got("10.1.0.0/20", "cidr") == [True, False, False, False]
    assert got("10.1.2.3", "prefix") == [True, False, False, False]
