"""Structured Streaming forms of the batch operators.

Watermarks bound the state of windows, of duplicates and of keyed processors: those take a key's rows in the order of
event time, wait for the watermark before they decide, and give up what can't matter any more by event-time timers.
``event_time`` is the event's ts as a timestamp; rows later than the watermark are told apart by :func:`split_late_stream`,
written to a partition of their own, and mark their hour for :func:`secspark.operators.rollups.refresh_written`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from secspark.functions.scalar import unused
from secspark.operators.normalize import match_iocs

#: Event time after which a silent host's last state is given up: 30 days.
IDLE_S = 30 * 86400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk, beyond the heap; stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# T1
def stream_events(spark: SparkSession, path: str, schema: str, normalise: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    """New files of a landing folder as event rows with event_time; ``normalise`` is any chain of row-wise operators."""
    raw = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return with_event_time(normalise(raw))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds("ts"))


# T2
def hourly_rollup(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """bucket, keys, n, last_ts; for update mode."""
    w = events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 hour"), *keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return w.select(F.unix_timestamp("window.start").alias("bucket"), *keys, "n", "last_ts")


# T3
def sliding_rule(events: DataFrame, predicate: Column, window_s: int, interval_s: int, threshold: int, by: list[str] = (), late: str = "10 minutes") -> DataFrame:
    """Windows of ``window_s`` every ``interval_s`` whose count is above the threshold."""
    hits = events.where(predicate).withWatermark("event_time", late)
    w = hits.groupBy(F.window("event_time", f"{window_s} seconds", f"{interval_s} seconds"), *by).agg(F.count("*").alias("value"))
    return w.where(F.col("value") > threshold).select(F.unix_timestamp("window.start").alias("start"), F.unix_timestamp("window.end").alias("end"), *by, "value")


# T4
def split_late(batch: DataFrame, watermark: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a micro-batch; rows without a time are never late."""
    late = F.coalesce(F.col("ts") < watermark, F.lit(False))
    return batch.where(~late), batch.where(late)


def split_late_stream(events: DataFrame, late_s: int, path: str, checkpoint: str) -> DataStreamWriter:
    """Tells rows that are older than the watermark when their batch begins from the others.

    Tables under ``path``: ``rows`` (partitions ``late`` and ``batch``), ``marks`` (newest ts up to each batch) and ``hours``
    (hours that late rows of a batch fall in, for :func:`secspark.operators.rollups.refresh_written`). The watermark is the newest ts of all earlier
    batches less ``late_s``, as Spark's is. A batch reads the one mark of the batch before it and writes its rows in
    one pass, so its cost doesn't grow with what is there. A batch that runs again replaces what it wrote.
    """

    def step(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema("newest long").parquet(f"{path}/marks/batch={n - 1}").first()["newest"] if n else None
        late = F.lit(False) if before is None else F.coalesce(F.col("ts") < before - late_s, F.lit(False))
        seen = Observation(f"newest-{n}")
        rows = df.withColumns({"late": late, "batch": F.lit(n)}).observe(seen, F.max("ts").alias("newest"), F.count_if(F.col("late")).alias("late"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("late", "batch").parquet(f"{path}/rows")
        newest = max((x for x in (before, seen.get["newest"]) if x is not None), default=None)
        if seen.get["late"]:
            some = spark.read.schema("ts long").parquet(f"{path}/rows/late=true/batch={n}")
            some.select((F.floor(F.col("ts") / 3600) * 3600).alias("bucket")).distinct().write.mode("overwrite").parquet(f"{path}/hours/batch={n}")
        # last: a batch without its mark has not ended
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def late_rows(spark: SparkSession, path: str, schema: str, late: bool = True) -> DataFrame:
    """Rows of :func:`split_late_stream`, late ones or those in time; only their partitions are read."""
    return spark.read.schema(f"{schema}, late boolean, batch int").parquet(f"{path}/rows").where(F.col("late") == late).drop("late", "batch")


# T5
def dedup_stream(events: DataFrame, within: str = "1 day") -> DataFrame:
    """One row for each (host, dedup) inside the watermark; rows without a key pass under a key of their own."""
    key = F.coalesce(F.concat(F.length(F.coalesce("host", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("host", F.lit("")), F.lit(":"), "dedup"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    name = unused(events, "_key")
    return events.withColumn(name, key).withWatermark("event_time", within).dropDuplicatesWithinWatermark([name]).drop(name)


# T6
class OrderedProcessor(StatefulProcessor):
    """Hands a key's rows on in the order of time, once the watermark says that no earlier one can come.

    Until then they wait in state with a count for each second and item, an entry for each ``SLOT_S`` seconds: a busy key is
    taken slot by slot, so that a worker holds one slot of it, or ``HELD`` new counts, at a time, and state is read and written
    once a slot. A timer at the first waiting second wakes the key; :meth:`take` gets all items of a second and returns what goes
    out. :meth:`load` and :meth:`save` stand around all seconds of a call. A key with nothing left to wait for is forgotten
    when :meth:`until` has passed.
    """

    SLOT_S, HELD = 3600, 100_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long", "ts array<long>, item array<string>, n array<long>")
        self.alarm = handle.getValueState("alarm", "at long")

    def load(self) -> None:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def take(self, key: tuple, ts: int, items: dict[str, int]) -> list[dict]:
        raise NotImplementedError

    def until(self) -> int | None:
        """Last second in which what is kept of the key can matter; None if nothing is kept."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def _wake_at(self, seconds: int | None) -> None:
        at = self.alarm.get()[0] if self.alarm.exists() else None
        if at == seconds:
            return
        if at is not None:
            self.handle.deleteTimer(at * 1000)
            self.alarm.clear()
        if seconds is not None:
            self.handle.registerTimer(seconds * 1000)
            self.alarm.update((seconds,))

    def _waiting(self, slot: int) -> dict[tuple[int, str], int]:
        if not self.pending.containsKey((slot,)):
            return {}
        ts, item, n = self.pending.getValue((slot,))
        return dict(zip(zip(ts, item), n))

    def _wait(self, slot: int, counts: dict[tuple[int, str], int]) -> None:
        self.pending.updateValue((slot,), ([ts for ts, _ in counts], [item for _, item in counts], list(counts.values())))

    def _add(self, slots: dict[int, dict[tuple[int, str], int]]) -> None:
        for slot, new in slots.items():
            counts = self._waiting(slot)
            for at, n in new.items():
                counts[at] = counts.get(at, 0) + n
            self._wait(slot, counts)

    def handleInputRows(self, key, rows, timers):
        first, slots, held = None, {}, 0
        for frame in rows:
            for (ts, item), n in frame.groupby(["ts", "item"], sort=False).size().items():
                at, new = (int(ts), item), slots.setdefault(int(ts) // self.SLOT_S, {})
                held += at not in new
                new[at] = new.get(at, 0) + int(n)
                first = at[0] if first is None else min(first, at[0])
            if held >= self.HELD:
                self._add(slots)
                slots, held = {}, 0
        self._add(slots)
        at = self.alarm.get()[0] if self.alarm.exists() else None
        if first is not None and (at is None or first < at):
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        self.load()
        later = None
        for slot in sorted(k[0] for k in self.pending.keys()):
            due: dict[int, dict[str, int]] = {}
            rest = {}
            for (ts, item), n in self._waiting(slot).items():
                if ts * 1000 <= now:
                    due.setdefault(ts, {})[item] = n
                else:
                    rest[ts, item] = n
            out = [row for ts in sorted(due) for row in self.take(key, ts, due[ts])]
            if not rest:
                self.pending.removeKey((slot,))
            elif due:
                self._wait(slot, rest)
            if out:
                yield pd.DataFrame(out)
            if rest:  # all slots after it are later
                later = min(ts for ts, _ in rest)
                break
        gone = False
        if later is None:
            later = self.until()
            if later is not None and later * 1000 <= now:
                gone, later = True, None
        if gone:
            self.forget()
        else:
            self.save()
        self._wake_at(later)

    def close(self) -> None:
        pass


class SequenceProcessor(OrderedProcessor):
    """All beginnings of a sequence at once: of those that have got equally far only the latest counts, so state is one row
    for each step and hit wanted at most."""

    def __init__(self, counts: list[int], window_s: int):
        self.counts, self.window_s = counts, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.begun = handle.getMapState("begun", "step int, hits int", "start long")

    def load(self):
        self.open = {(step, n): start for (step, n), (start,) in self.begun.iterator()}

    def save(self):
        self.begun.clear()
        for at, start in self.open.items():
            self.begun.updateValue(at, (start,))

    def take(self, key, ts, items):
        hits = [items.get(str(i), 0) for i in range(len(self.counts))]
        open_ = [(step, n, start) for (step, n), start in self.open.items() if ts - start <= self.window_s]
        if hits[0]:
            open_.append((0, 0, ts))
        done, left = False, {}
        for step, n, start in open_:
            n += hits[step]
            while n >= self.counts[step]:  # hits of the same second count for the next step, as they do in the batch form
                step += 1
                if step == len(self.counts):
                    break
                n = hits[step]
            if step == len(self.counts):
                done = True
            else:
                left[step, n] = max(start, left.get((step, n), start))
        self.open = left
        return [{"key": key[0], "completed": ts}] if done else []

    def until(self):
        return max((start + self.window_s + 1 for start in self.open.values()), default=None)

    def forget(self):
        self.begun.clear()


def _in_order(rows: DataFrame, keys: list[str], processor: OrderedProcessor, schema: str, late: str) -> DataFrame:
    """``rows``: keys, ts, item, event_time."""
    return rows.withWatermark("event_time", late).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def correlate_stream(events: DataFrame, steps: list[tuple[Column, int]], key: str, window_s: int, late: str = "10 minutes") -> DataFrame:
    """key, completed: what :func:`secspark.operators.detect.correlate_sequence` completes in any window of ``window_s`` seconds
    that begins at a hit of the first step; each time of completion once.

    A completion comes out when the watermark (``late`` behind the newest hit) has passed it. Rows that come later than the
    watermark are left out by Spark; rows in the wrong order before it do no harm. Rows without a key or a time are no hits.
    """
    if not 0 < len(steps) <= 16:
        raise ValueError("1 to 16 steps")
    numbered = F.filter(F.array(*[F.when(p, F.lit(str(i))) for i, (p, _) in enumerate(steps)]), lambda x: x.isNotNull())
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.timestamp_seconds("ts").alias("event_time"), F.explode(numbered).alias("item"))
    rows = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    return _in_order(rows, ["key"], SequenceProcessor([n for _, n in steps], window_s), "key string, completed long", late)


class ThrottleProcessor(OrderedProcessor):
    """Lets a key through once in a window."""

    def __init__(self, window_s: int):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts long")

    def load(self):
        self.fired = self.last.get()[0] if self.last.exists() else None

    def save(self):
        if self.fired is not None:
            self.last.update((self.fired,))

    def take(self, key, ts, items):
        if self.fired is not None and ts - self.fired < self.window_s:
            return []
        self.fired = ts
        return [{"key": key[0], "ts": ts}]

    def until(self):
        return None if self.fired is None else self.fired + self.window_s

    def forget(self):
        self.last.clear()


def throttle_stream(units: DataFrame, window_s: int, late: str = "10 minutes") -> DataFrame:
    """key, ts of the units that may fire, in the order of time; a key's state goes when its window is over."""
    rows = units.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.timestamp_seconds("ts").alias("event_time"), F.lit("").alias("item"))
    return _in_order(rows.where("key is not null and ts is not null"), ["key"], ThrottleProcessor(window_s), "key string, ts long", late)


class SnapshotProcessor(OrderedProcessor):
    """Passes a state on when its hash changes; states of one second in the order of their hashes."""

    def __init__(self, idle_s: int):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "hash string, ts long")

    def load(self):
        self.seen = tuple(self.last.get()) if self.last.exists() else None

    def save(self):
        if self.seen is not None:
            self.last.update(self.seen)

    def take(self, key, ts, items):
        out, last = [], self.seen[0] if self.seen else None
        for value in sorted(items):
            if value != last:
                out.append({"kind": key[0], "host": key[1], "ts": ts, "hash": value})
                last = value
        self.seen = (last, ts)
        return out

    def until(self):
        return self.seen[1] + self.idle_s if self.seen else None

    def forget(self):
        self.last.clear()


def snapshot_changes(snapshots: DataFrame, idle_s: int = IDLE_S, late: str = "10 minutes") -> DataFrame:
    """kind, host, ts, hash whenever the state of a host changes; a host that is silent for ``idle_s`` seconds begins anew."""
    rows = snapshots.select("kind", "host", F.col("ts").cast("long").alias("ts"), F.timestamp_seconds("ts").alias("event_time"), F.col("hash").alias("item"))
    return _in_order(rows.where("ts is not null and item is not null"), ["kind", "host"], SnapshotProcessor(idle_s), "kind string, host string, ts long, hash string", late)


# T7
def enrich_stream(events: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Stream and static table: left join, the table read anew with every micro-batch."""
    return events.join(lookup, on, "left")


def match_iocs_stream(events: DataFrame, iocs: Callable[[], DataFrame], now: Callable[[], int], sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Batch indicator match on every micro-batch, with the indicators as they stand then."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(match_iocs(df, iocs(), now()), n))


# T8
def closed_buckets(events: DataFrame, entity: str, bucket: str, late: str = "10 minutes") -> DataFrame:
    """entity, bucket, value of closed buckets; append mode."""
    w = events.withWatermark("event_time", late).groupBy(F.window("event_time", bucket), F.col(entity).alias("entity")).agg(F.count("*").cast("double").alias("value"))
    return w.select("entity", F.unix_timestamp("window.start").alias("bucket"), "value")


class BaselineProcessor(StatefulProcessor):
    """Scores closed buckets against the entity's earlier ones in the window.

    State is the buckets of the window and their moments: number, sum and sum of squares, whole numbers, so that a bucket
    that leaves the window is taken off without a rest. Buckets close in the order of time, so batches need no timers.
    """

    def __init__(self, window_s: int, min_samples: int, idle_s: int | None):
        self.window_s, self.min_samples, self.idle_s = window_s, min_samples, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.idle_s and self.idle_s * 1000
        self.buckets = handle.getMapState("buckets", "bucket long", "value long", ttl)
        self.moments = handle.getValueState("moments", "n long, total decimal(38,0), squares decimal(38,0)", ttl)

    def handleInputRows(self, key, rows, timers):
        n, total, squares = (int(x) for x in self.moments.get()) if self.moments.exists() else (0, 0, 0)
        held = sorted((b, v) for (b,), (v,) in self.buckets.iterator())
        out = []
        for bucket, value in sorted((int(b), int(v)) for frame in rows for b, v in zip(frame["bucket"], frame["value"])):
            while held and held[0][0] < bucket - self.window_s:
                old, gone = held.pop(0)
                n, total, squares = n - 1, total - gone, squares - gone * gone
                self.buckets.removeKey((old,))
            mean = total / n if n else None
            spread = n * squares - total * total
            sd = math.sqrt(spread / (n * (n - 1))) if n > 1 else None
            z = (value - mean) / sd if n >= max(2, self.min_samples) and spread > 0 else None
            out.append((key[0], bucket, float(value), n, mean, sd, z))
            held.append((bucket, value))
            n, total, squares = n + 1, total + value, squares + value * value
            self.buckets.updateValue((bucket,), (value,))
        self.moments.update((n, Decimal(total), Decimal(squares)))
        yield pd.DataFrame(out, columns=["entity", "bucket", "value", "n", "mean", "sd", "z"]).astype({"n": "int64", "mean": "float64", "sd": "float64", "z": "float64"})

    def close(self) -> None:
        pass


def baseline_stream(events: DataFrame, entity: str, bucket_s: int, window_s: int, min_samples: int, late: str = "10 minutes", idle_s: int | None = None) -> DataFrame:
    """entity, bucket, value, n, mean, sd, z of every closed bucket: :func:`secspark.operators.detect.baseline_scores` on a stream.

    A bucket is scored once, when it closes; rows without an entity or a time don't count. With ``idle_s`` an entity is
    forgotten after so many seconds of processing time, which a query that runs once can't wait for.
    """
    named = events.where(F.col(entity).isNotNull() & F.col("event_time").isNotNull())
    closed = closed_buckets(named, entity, f"{bucket_s} seconds", late).withColumn("entity", F.col("entity").cast("string"))
    processor = BaselineProcessor(window_s, min_samples, idle_s)
    return closed.groupBy("entity").transformWithStateInPandas(processor, "entity string, bucket long, value double, n long, mean double, sd double, z double", "Append", "ProcessingTime" if idle_s else "None")


# T9
def forward_stream(events: DataFrame, predicate: Column, fmt: str, send: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """At least once: the checkpoint moves on only after ``send`` has returned."""
    from secspark.sources.sinks import render

    def step(df: DataFrame, n: int) -> None:
        send(df.where(predicate).select("id", render(df, fmt).alias("body")).orderBy("id"), n)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
