import hashlib
from collections import defaultdict

import pytest

from secspark.llm.exact import digests, duplicate_groups, exact_dedup, merge_runs

from .helpers import SCHEMA, as_set, rows, table


@pytest.mark.parametrize("keep", ["max", "min"])
def test_brute_force(spark, keep):
    data = rows(n=200)
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = duplicate_groups(table(spark, data).repartition(13), keep)
    assert as_set(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(map(str, want))
    stay = exact_dedup(table(spark, data), keep)
    assert stay.columns == table(spark, data).columns
    assert sorted(t or "" for (t,) in stay.select("text").collect()) == sorted(groups)


@pytest.mark.parametrize("runs", [1, 2, 5, 16, 64])
def test_rounds_agree(spark, runs):
    rows_ = digests(table(spark)).repartition(9)
    merged = merge_runs(rows_, "min", runs)
    assert as_set(merged, "digest", "keep_id", "group_size") == as_set(merge_runs(rows_.coalesce(1), "min", 1), "digest", "keep_id", "group_size")
    assert merged.count() == rows_.select("digest").distinct().count()


def test_plan_merges_sorted_runs(spark):
    """A round for each bit of the run's number, each an exchange between two sorts with an aggregate over sorted rows."""
    plan = merge_runs(digests(table(spark)), "max", 16)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 8 and "HashAggregate" not in plan


def test_clashing_columns(spark):
    docs = table(spark, n=40).selectExpr("*", "'a' AS _g", "'b' AS row", "'c' AS digest", "'d' AS keep_id", "'e' AS run", "1 AS h2", "'f' AS `keep.id`")
    stay = exact_dedup(docs, "min")
    assert stay.columns == docs.columns and stay.schema.simpleString() == docs.schema.simpleString()
    assert {(r["_g"], r["row"], r["digest"], r["keep_id"], r["run"], r["h2"], r["keep.id"]) for r in stay.collect()} == {("a", "b", "c", "d", "e", 1, "f")}


def test_empty(spark):
    assert duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
