"""Streaming operators against their batch forms, with availableNow triggers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from secspark.operators.detect import baseline_scores, correlate_sequence
from secspark.operators.normalize import capture_snapshots
from secspark.streaming import stream as T

SCHEMA = "id long, ts long, host string, source string, action string, dedup string, message string, severity int, fields string"


@pytest.fixture()
def landed(spark, tmp_path):
    rows = [(i, 1_704_844_800 + i * 97, f"h{i % 5}", "error" if i % 3 else "click", "failure" if i % 4 else "success", f"d{i % 50}" if i % 7 else None, f"m{i}", i % 4, "{}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):  # files arrive in the order of time
        df.where(F.col("id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05)
    T.use_rocksdb(spark)
    return df, f"file://{tmp_path}"


def drain(df, tmp, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def events(spark, tmp, files=1):
    return T.stream_events(spark, f"{tmp}/in", SCHEMA, files_per_trigger=files)


def test_hourly_rollup(spark, landed):
    df, tmp = landed
    got = {}
    for b, s, n, last in drain(T.hourly_rollup(events(spark, tmp), ["source"]), tmp, "hourly", "update"):
        got[(b, s)] = max(got.get((b, s), (0, 0)), (n, last))
    want = df.groupBy((F.floor(F.col("ts") / 3600) * 3600).alias("b"), "source").agg(F.count("*"), F.max("ts")).collect()
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in want}


def test_sliding_rule(spark, landed):
    df, tmp = landed
    got = drain(T.sliding_rule(events(spark, tmp, 10), F.col("action") == "failure", 3600, 1800, 5, ["host"]), tmp, "sliding", "update")
    ts = {(r["host"], r["ts"]) for r in df.where("action = 'failure'").collect()}
    want = set()
    for h in {h for h, _ in ts}:
        for s in range(1_704_844_800 - 3600, 1_704_844_800 + 400 * 97 + 1, 1800):
            n = sum(1 for x, t in ts if x == h and s <= t < s + 3600)
            if n > 5:
                want.add((s, s + 3600, h, n))
    assert set(got) == want


def test_dedup(spark, landed):
    df, tmp = landed
    got = drain(T.dedup_stream(events(spark, tmp)).select("id", "host", "dedup"), tmp, "dedup")
    assert len(got) == df.where("dedup is null").count() + df.where("dedup is not null").select("host", "dedup").distinct().count()


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def windows(df, steps, key, window_s):
    """What the batch operator completes in the windows that begin at each hit of the first step."""
    out = set()
    for k, s in {(r[0], r[1]) for r in df.where(steps[0][0]).where(F.col(key).isNotNull()).select(key, "ts").collect()}:
        out |= {tuple(r) for r in correlate_sequence(df.where(F.col(key) == k), steps, key, s, s + window_s).collect()}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_sequence_equals_the_batch_form_on_every_window(spark, tmp_path, seed):
    T.use_rocksdb(spark)
    r, path = random.Random(seed), f"file://{tmp_path}"
    steps = [(F.col("kind") == "a", 2), (F.col("kind").isin("b", "ab"), 2), (F.col("kind").isin("c", "a"), 1)]  # one row can be a hit of two steps
    rows = [(r.choice(["x", "x", "y", None]), r.randint(0, 60) if i % 9 else None, r.choice(["a", "a", "b", "ab", "c", "-"])) for i in range(70)]
    rows += [("x", 5000, "c"), ("y", 5000, "-")]  # moves the watermark past all others
    r.shuffle(rows)
    got = []
    schema = "host string, ts long, kind string"
    last = [x for x in rows if x[1] == 5000]
    for part in ([x for x in rows if x not in last][::2], [x for x in rows if x not in last][1::2], last):  # three runs that go on from the checkpoint
        land(spark, part, schema, f"{path}/in")
        live = T.correlate_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), steps, "host", 25, "4000 seconds")
        q = live.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.read.parquet(f"{path}/out").collect())
    df = spark.createDataFrame([x for x in rows if x[1] is not None and x[1] < 1000], schema)
    assert got == windows(df, steps, "host", 25) and len(got) > 1


def test_sequence_may_begin_at_any_earlier_hit(spark, tmp_path):
    T.use_rocksdb(spark)
    path, schema = f"file://{tmp_path}", "host string, ts long"
    land(spark, [("h", t) for t in (12, 0, 11, 9, 999)], schema, f"{path}/in")
    got = drain(T.correlate_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), [(F.lit(True), 3)], "host", 10, "5 seconds"), path, "any")
    assert got == [("h", 12)]


def test_baseline_equals_the_batch_form(spark, tmp_path):
    T.use_rocksdb(spark)
    r, path, schema = random.Random(4), f"file://{tmp_path}", "host string, ts long, event_time timestamp"
    rows = [(r.choice(["x", "y", None]), 100 * b + r.randint(0, 99)) for b in range(30) for _ in range(r.randint(0, 6))] + [("z", 100_000)]
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        df = spark.createDataFrame(part, "host string, ts long").withColumn("event_time", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        live = T.baseline_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), "host", 100, 700, 3, "1 second")
        live.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    near = lambda t: tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in t)
    got = sorted((near(x) for x in spark.read.parquet(f"{path}/out").collect()), key=str)
    want = baseline_scores(spark.createDataFrame(rows[:-1], "host string, ts long"), "host", 100, 700, 3)
    assert got == sorted((near(x) for x in want.collect()), key=str) and any(x[-1] is not None for x in got)


def test_late_rows_batch_by_batch(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "id long, ts long"
    parts = [[(1, 10_000), (2, None)], [(3, 9_000), (4, 20_000), (5, 9_950)], [(6, 100), (7, None), (8, 19_950)]]
    for part in parts:  # each run is one batch and goes on from the checkpoint
        land(spark, part, schema, f"{path}/in")
        T.split_late_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), 100, f"{path}/out", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    ids = lambda late: sorted(r["id"] for r in T.late_rows(spark, f"{path}/out", schema, late).collect())
    assert ids(True) == [3, 6] and ids(False) == [1, 2, 4, 5, 7, 8]
    assert sorted((r["bucket"], r["batch"]) for r in spark.read.parquet(f"{path}/out/hours").collect()) == [(0, 2), (7200, 1)]
    # a batch that runs again replaces its rows, and reads only the mark of the one before it
    step = T.split_late_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), 100, f"{path}/out", f"{path}/cp2")
    assert step is not None
    assert spark.read.parquet(f"{path}/out/marks").where("batch = 1").first()["newest"] == 20_000


def test_throttle_and_snapshots(spark, landed):
    df, tmp = landed
    end = df.agg(F.max("ts")).first()[0] - 600
    got = drain(T.throttle_stream(events(spark, tmp).select(F.col("host").alias("key"), "ts"), 5000), tmp, "throttle")
    want = []
    for h in sorted({r["host"] for r in df.collect()}):
        last = None
        for t in sorted(r["ts"] for r in df.where(F.col("host") == h).collect()):
            if t <= end and (last is None or t - last >= 5000):
                want.append((h, t))
                last = t
    assert sorted(got) == want and len(want) > 10
    snaps = events(spark, tmp).select(F.lit("state").alias("kind"), "host", "ts", F.col("action").alias("hash"))
    got = drain(T.snapshot_changes(snaps), tmp, "snaps")
    want = capture_snapshots(df.where(F.col("ts") <= end).select("id", "ts", F.lit("state").alias("kind"), "host", F.col("action").alias("hash")))
    assert sorted(got) == sorted((r["kind"], r["host"], r["ts"], r["hash"]) for r in want.collect())


def test_batches(spark, landed):
    df, tmp = landed
    sent, hits = [], []
    q = T.forward_stream(events(spark, tmp), F.col("severity") >= 3, "collector", lambda d, n: sent.extend(r["id"] for r in d.collect()), f"{tmp}/cp-f").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(sent) == [r["id"] for r in df.where("severity >= 3").orderBy("id").collect()]
    iocs = spark.createDataFrame([("ip", "1.2.3.4", "f", 90, 3, 0)], "type string, value string, source string, confidence int, severity int, expires long")
    ev = events(spark, tmp, 10).withColumn("src_ip", F.when(F.col("id") == 7, "1.2.3.4"))
    q = T.match_iocs_stream(ev, lambda: iocs, lambda: 1, lambda d, n: hits.extend(r["id"] for r in d.where("threat_intel").collect()), f"{tmp}/cp-i").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert hits == [7]
    ok, late = T.split_late(df, 1_704_844_800 + 97 * 100)
    assert late.count() == 100 and ok.count() == 300
    ok, late = T.split_late(spark.createDataFrame([(1, None), (2, 5)], "id long, ts long"), 10)
    assert [r["id"] for r in ok.collect()] == [1] and [r["id"] for r in late.collect()] == [2]


def test_closed_buckets_and_lookup(spark, landed):
    df, tmp = landed
    got = drain(T.closed_buckets(events(spark, tmp), "host", "1 hour"), tmp, "closed")
    assert got and all(v > 0 for _, _, v in got)
    names = spark.createDataFrame([("h1", "one")], "host string, name string")
    got = drain(T.enrich_stream(events(spark, tmp), names, "host").select("id", "name"), tmp, "named")
    assert sum(n == "one" for _, n in got) == df.where("host = 'h1'").count()


class _State(dict):
    """A map or value state that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("updateValue", "getValue", "containsKey", "removeKey"):
            _State.calls += 1
        return super().__getattribute__(name)

    def updateValue(self, k, v):
        self[k] = v

    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))

    def update(self, v):
        self[()] = v

    def get(self):
        return self[()]

    def exists(self):
        return () in self


class _Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return _State()

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Now(int):
    def getCurrentWatermarkInMs(self):
        return int(self)


def test_a_busy_key_is_taken_slot_by_slot():
    import pandas as pd

    p, h = T.SnapshotProcessor(10**9), _Handle()
    p.init(h)
    _State.calls, hours = 0, 50
    rows = [(s, "ab"[s // 7 % 2]) for s in range(0, hours * 3600, 7)]
    random.Random(1).shuffle(rows)
    list(p.handleInputRows(("k", "h"), iter([pd.DataFrame(rows[i : i + 5000], columns=["ts", "item"]) for i in range(0, len(rows), 5000)]), None))
    assert h.timers == {0}
    h.timers.clear()
    end = hours * 3600 - 5000
    frames = list(p.handleExpiredTimer(("k", "h"), _Now(end * 1000), None))
    assert [t for f in frames for t in f["ts"]] == [t for t in range(0, hours * 3600, 7) if t <= end]
    assert len(frames) > 40 and max(map(len, frames)) <= 3600  # one frame of all before
    assert _State.calls < len(rows) / 10  # four calls a row before
    assert h.timers == {(end // 7 + 1) * 7 * 1000}
    rest = list(p.handleExpiredTimer(("k", "h"), _Now(hours * 3600 * 1000), None))
    assert sum(map(len, frames + rest)) == len(rows) and not p.pending
