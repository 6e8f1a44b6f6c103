"""Written tables: refresh of rollups, purges and retention, and what happens when they break off."""

import os

import pytest
from pyspark.sql import functions as F

from secspark.operators import govern as G
from secspark.operators import rollups as RU
from secspark.sources import files

SCHEMA = "id long, ts long, source string, severity int, action string, src_ip string, host string, env_id string"
HOLDS = "scope_source string, scope_start_ts long, scope_end_ts long, active boolean"
T = 1_704_844_800


def rows(spark, first, ts):
    return spark.createDataFrame([(first + i, t, "s" if i % 2 else None, i % 5, "a", f"10.0.0.{i % 3}", "h1" if i % 3 else "h2", "prod") for i, t in enumerate(ts)], SCHEMA)


def stamps(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def plain(df):
    return sorted(map(str, df.collect()))


def test_refresh_writes_dirty_hours_only(spark, tmp_path):
    out, ledger = f"{tmp_path}/rollup", f"{tmp_path}/ledger"
    first = rows(spark, 0, [T + 3600 * h + m for h in range(10) for m in (0, 5, 9)] + [None])
    done = RU.refresh_written(first, out, ledger, T + 9 * 3600, topn=2)
    assert done.count() == 10
    before = stamps(out)
    late = rows(spark, 100, [T + 3600 * 2 + 7, T + 3600 * 10])
    everything = first.union(late)
    done = RU.refresh_written(everything, out, ledger, T + 10 * 3600, topn=2)
    hours = sorted((r["bucket"] - T) // 3600 for r in done.collect())
    assert hours == [2, 9, 10]  # the late hour, and the two hot ones
    after = stamps(out)
    gone = {k for k in before if k not in after}
    assert {k: v for k, v in after.items() if k in before} == {k: v for k, v in before.items() if k not in gone}
    assert {k.split("bucket=")[1].split("/")[0] for k in gone} == {str(T + 3600 * h) for h in (2, 9)}
    assert plain(RU.read_rollup(spark, out)) == plain(RU.event_rollup(everything.where("ts is not null"), topn=2).select(RU.read_rollup(spark, out).columns))
    # an hour whose rows are gone loses its partition
    left = everything.where(f"ts < {T + 3600 * 3} or ts >= {T + 3600 * 4} or ts is null")
    done = RU.refresh_written(left, out, ledger, T + 10 * 3600, spark.createDataFrame([(T + 3600 * 3,)], "bucket long"), topn=2)
    assert [r["bucket"] for r in done.where("not rows").collect()] == [T + 3600 * 3]
    assert plain(RU.read_rollup(spark, out)) == plain(RU.event_rollup(left.where("ts is not null"), topn=2).select(RU.read_rollup(spark, out).columns))
    assert RU.covered(spark, ledger)["covered_id"] == 101 and RU.covered(spark, ledger)["run"] == 2


def test_refresh_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    out, ledger = f"{tmp_path}/rollup", f"{tmp_path}/ledger"
    df = rows(spark, 0, [T, T + 3600])
    monkeypatch.setattr(files, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        RU.refresh_written(df, out, ledger, T, spark.createDataFrame([(T + 7200,)], "bucket long"))
    monkeypatch.undo()
    assert RU.covered(spark, ledger) is None
    assert RU.refresh_written(df, out, ledger, T).count() == 2 and RU.read_rollup(spark, out).agg(F.sum("n")).first()[0] == 2


def test_empty_refresh(spark, tmp_path):
    assert RU.refresh_written(rows(spark, 0, [None]), f"{tmp_path}/r", f"{tmp_path}/l", T).count() == 0


def stored(spark, tmp_path):
    df = rows(spark, 0, [T + 86400 * (i % 4) + i for i in range(40)] + [None, None]).withColumn("day", F.coalesce(F.to_date(F.timestamp_seconds("ts")).cast("string"), F.lit("no day")))
    path = f"{tmp_path}/events table"
    df.coalesce(1).write.partitionBy("day").parquet(path)
    return df, path, SCHEMA + ", day string"


def test_purge_rewrites_only_files_with_doomed_rows(spark, tmp_path):
    df, path, schema = stored(spark, tmp_path)
    before = stamps(path)
    scope = {"host": "h2", "start": T, "end": T + 86400 * 2 - 1}
    plan = tuple(G.plan_digest(G.purge_plan(spark.read.schema(schema).parquet(path), scope)).first())
    with pytest.raises(RuntimeError, match="changed"):
        G.purge_written(spark, path, schema, scope, (plan[0], plan[1] ^ 1), None, f"{tmp_path}/w0", ["day"])
    holds = spark.createDataFrame([("s", T, T + 100, True)], HOLDS)
    proof, hours = G.purge_written(spark, path, schema, scope, plan, holds, f"{tmp_path}/w", ["day"])
    going = df.where((F.col("host") == "h2") & F.col("ts").between(T, T + 86400 * 2 - 1) & ~((F.coalesce("source", F.lit("")) == "s") & F.col("ts").between(T, T + 100)))
    assert plain(spark.read.schema(schema).parquet(path)) == plain(df.exceptAll(going).select(spark.read.schema(schema).parquet(path).columns))
    after = stamps(path)
    assert sum(k in after for k in before) == 3 and all(after[k] == v for k, v in before.items() if k in after)  # two days, and no day
    p = proof.first()
    assert p["files"] == 2 and p["rows_before"] == p["rows_gone"] + p["rows_after"] and p["digest_before"] == p["digest_after"] and p["rows_gone"] == going.count()
    assert plain(hours) == plain(going.select((F.floor(F.col("ts") / 3600) * 3600).alias("bucket")).distinct())


@pytest.mark.parametrize("at", ["move", "delete"])
def test_purge_that_broke_off_in_the_swap_can_be_ended(spark, tmp_path, monkeypatch, at):
    df, path, schema = stored(spark, tmp_path)
    scope = {"host": "h2", "start": T, "end": T + 86400 * 2 - 1}
    plan = tuple(G.plan_digest(G.purge_plan(df, scope)).first())
    whole, calls = getattr(files, at), []

    def once(spark, *a):
        calls.append(a)
        if any("day=" in str(x) for x in a) and sum("day=" in str(c) for c in calls) == 2:
            raise OSError("lost")
        return whole(spark, *a)

    monkeypatch.setattr(files, at, once)
    none = spark.createDataFrame([], HOLDS)
    with pytest.raises(OSError):
        G.purge_written(spark, path, schema, scope, plan, none, f"{tmp_path}/w", ["day"])
    monkeypatch.undo()
    G.finish_rewrite(spark, path, f"{tmp_path}/w")
    proof = G.finish_rewrite(spark, path, f"{tmp_path}/w")
    want = df.where(~F.coalesce((F.col("host") == "h2") & F.col("ts").between(T, T + 86400 * 2 - 1), F.lit(False)))
    got = spark.read.schema(schema).parquet(path)
    assert plain(got) == plain(want.select(got.columns)) and proof.first()["files"] == 2


def test_nothing_is_deleted_without_readable_holds(spark, tmp_path):
    df, path, schema = stored(spark, tmp_path)
    before, scope = stamps(path), {"host": "h2", "start": 0, "end": T * 2}
    plan = tuple(G.plan_digest(G.purge_plan(df, scope)).first())
    stay, hours = G.purge_apply(df, scope, plan, None)
    assert stay.count() == df.count() and hours.count() == 0
    proof, hours = G.purge_written(spark, path, schema, scope, plan, None, f"{tmp_path}/w", ["day"])
    assert stamps(path) == before and proof.first()["rows_gone"] == 0 and hours.count() == 0
    proof, _ = G.retain_written(spark, path, schema, {}, 7, None, T * 2, [], f"{tmp_path}/w", ["day"])
    assert stamps(path) == before
    assert G.retain(df, {}, 7, None, T * 2).count() == df.count()


@pytest.mark.parametrize("size, fits", [("64m", True), ("100k", False)])
def test_a_day_is_dealt_by_its_size_and_rows_are_not_shuffled_by_holds(spark, tmp_path, size, fits):
    df = spark.range(0, 40_000, 1, 4).selectExpr("id", f"{T} + id AS ts", "CASE WHEN id % 3 = 0 THEN 's' END AS source", "1 AS severity", "'a' AS action", "sha2(CAST(id AS string), 256) AS src_ip", "'h' AS host", "'prod' AS env_id", "'one day' AS day")
    path, schema = f"{tmp_path}/events", SCHEMA + ", day string"
    df.write.partitionBy("day").parquet(path)
    assert len(files.data_files(spark, path)) == 4
    holds = spark.createDataFrame([("s", None, None, True), ("u", None, None, False)], HOLDS)
    plan = G.retain(spark.read.schema(schema).parquet(path), {}, 7, G._written_holds(spark, holds, f"{tmp_path}/h"), T * 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        proof, _ = G.retain_written(spark, path, schema, {}, 7, holds, T * 2, [], f"{tmp_path}/w", ["day"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert proof.first()["rows_gone"] == 26_666 and (len(files.data_files(spark, path)) == 1) == fits
    assert plain(spark.read.schema(schema).parquet(path).select("id")) == plain(df.where("source = 's'").select("id"))


def test_rows_without_a_time_stay(spark, tmp_path):
    df, path, schema = stored(spark, tmp_path)
    none = spark.createDataFrame([], HOLDS)
    assert G.retain(df, {}, 7, none, T * 2).where("ts is null").count() == 2
    G.retain_written(spark, path, schema, {}, 7, none, T * 2, [], f"{tmp_path}/w", ["day"])
    assert spark.read.schema(schema).parquet(path).count() == 2
    old, raw = RU.metric_rollup(spark.createDataFrame([(None, "m", "{}", "h", 1.0), (5, "m", "{}", "h", 2.0)], "ts long, name string, labels string, host string, value double"), 10)
    assert old.count() == 1 and raw.count() == 1


def test_holds_by_source_day_and_open_ends(spark):
    df = spark.createDataFrame([(1, T, "a"), (2, T + 86400 * 9, "b"), (3, None, "a"), (4, T, None), (5, T - 1, "c")], "id long, ts long, source string")
    for hold, want in [(("a", None, None), {1, 3}), ((None, None, None), {1, 2, 3, 4, 5}), ((None, T, T + 10), {1, 4}), (("b", T, T + 86400 * 900), {2}), ((None, None, T - 1), {5}), (("c", T, None), set()), ((None, T + 5, T), set())]:
        holds = spark.createDataFrame([(*hold, True), ("a", None, None, False), ("a", None, None, None)], HOLDS)
        assert {r["id"] for r in G.held(df, holds).collect()} == want
        assert {r["id"] for r in G.legal_hold_filter(df, holds).collect()} == {1, 2, 3, 4, 5} - want
    twice = spark.createDataFrame([("a", None, None, True)] * 2 + [(None, T, T, True)], HOLDS)
    assert sorted(r["id"] for r in G.held(df, twice).collect()) == [1, 3, 4]
    many = spark.range(100_000).selectExpr("concat('s', id) AS scope_source", "id AS scope_start_ts", "id + 5 AS scope_end_ts", "true AS active")
    plan = G.legal_hold_filter(df, many)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rollup_and_raw_have_one_key_for_nulls(spark):
    df = rows(spark, 0, [T + 5, T + 3600, T + 3605, T + 7300]).withColumn("severity", F.lit(None).cast("int"))
    got = RU.merge_rollup_raw(RU.event_rollup(df), df, ["source", "severity"], T, T + 7400, T + 7200, 99)
    assert sorted(map(tuple, got.collect())) == [("", 0, 2), ("s", 0, 2)]
