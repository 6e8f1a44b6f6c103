"""Masks inside recorded searches: nothing comes out in clear, and nothing can be filtered by."""

import pytest
from pyspark.sql import functions as F

from secspark.operators.govern import under_masks
from secspark.operators.panels import report_rows
from secspark.operators.search import Search

SECRETS = {"10.0.0.1", "10.0.0.2", "bob"}
MASKS = {"src_ip": "hash", "user": "mask"}


@pytest.fixture(scope="module")
def base(spark):
    rows = [(1, 5, "10.0.0.1", "a", '{"user":"bob","k":"v"}', "from 10.0.0.1"), (2, 6, "10.0.0.2", "b", '{"user":"bob","k":"w"}', "x"), (3, None, None, None, None, None)]
    return spark.createDataFrame(rows, "id long, ts long, src_ip string, host string, fields string, message string")


def clear(df):
    return {s for s in SECRETS if any(s in str(r) for r in df.drop("message").collect())}


def member(k):
    return F.get_json_object("fields", f"$['{k}']")


@pytest.mark.parametrize("make", [
    lambda s: s.stats(("values", "src_ip"), "count", by=["host"]),
    lambda s: s.stats("count", by=["src_ip"]),
    lambda s: s.eval(who=F.concat(F.lit("ip "), "src_ip")).fields("id", "who"),
    lambda s: s.rename(who="src_ip").stats(("list", "who")),
    lambda s: s.eval(u=member("user")).stats(("values", "u"), ("max", "u")),
    lambda s: s.stats(F.max("src_ip").alias("m"), F.collect_set("fields").alias("f")),
    lambda s: s.top("src_ip"),
    lambda s: s.rex("src_ip", r"(?<net>\d+\.\d+)\.").eventstats(("max", "src_ip"), by=["host"]),
    lambda s: s.append(s.fields("src_ip").rename(host="src_ip")),
    lambda s: s.append(s.df.select(F.col("src_ip"), F.lit(1).alias("one"))),
    lambda s: s.join(s.fields("id", "src_ip").rename(other="src_ip"), "id"),
    lambda s: s.timechart(10, ("values", "src_ip")),
    lambda s: s.dedup("src_ip").sort("src_ip").head(5),
])
def test_no_value_in_clear(base, make):
    assert clear(base) == SECRETS
    assert clear(under_masks(make(Search(base)), MASKS, "salt")) == set()
    for part in report_rows(make(Search(base)), MASKS, "salt"):
        assert clear(part) == set()


@pytest.mark.parametrize("make", [
    lambda s: s.search(F.col("src_ip") == "10.0.0.1"),
    lambda s: s.where(F.col("src_ip").isNotNull()),
    lambda s: s.rename(who="src_ip").where(F.col("who") == "x"),
    lambda s: s.eval(who=F.lower("src_ip")).eval(again=F.length("who")).where(F.col("again") > 3),
    lambda s: s.rex("src_ip", r"(?<net>\d+)\.").where(F.col("net") == "10"),
    lambda s: s.stats(("max", "src_ip"), by=["host"]).where(F.col("max") == "x"),
    lambda s: s.stats(F.max("src_ip").alias("m")).where(F.col("m") == "x"),
    lambda s: s.stats("count", by=["src_ip"]).where(F.col("src_ip") == "x"),
    lambda s: s.where(member("user") == "bob"),
    lambda s: s.where(F.col("fields").contains("bob")),
    lambda s: s.eval(u=member("user")).where(F.col("u") == "bob"),
    lambda s: s.exclude("src_ip", ["10.0.0.0/8"]),
    lambda s: s.join(s.fields("src_ip"), "src_ip"),
    lambda s: s.append(s.where(F.col("src_ip") == "10.0.0.1")),
])
def test_filters_on_masked_values_are_refused(base, make):
    with pytest.raises(PermissionError):
        under_masks(make(Search(base)), MASKS, "salt")


def test_other_filters_stay(base):
    s = Search(base).where(F.col("host") == "a").where(member("k") == "v").search(start=1).rename(who="src_ip").stats("count", by=["host"]).where(F.col("count") > 0)
    assert [tuple(r) for r in under_masks(s, MASKS).collect()] == [("a", 1)]
    s = Search(base).rename(old="src_ip").rename(src_ip="host").where(F.col("src_ip") == "a")  # the name changes hands
    assert under_masks(s, {"src_ip": "hash"}).count() == 1
    s = Search(base).eval(src_ip=F.lit("public")).where(F.col("src_ip") == "public")
    assert under_masks(s, {"src_ip": "hash"}).count() == 3
    assert under_masks(Search(base), {}).count() == 3
