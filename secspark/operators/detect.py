"""Detection: threshold rules, alerts, sequences, baselines, suppression, routing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attr
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from secspark.functions.scalar import bucket
from secspark.operators.search import Search

TOLERANCE = 1e-9


def compare(value: Column, op: str, threshold: float) -> Column:
    """The six comparisons; equality within a tolerance."""
    near = F.abs(value - threshold) <= TOLERANCE
    return {">": lambda: value > threshold, ">=": lambda: value >= threshold, "<": lambda: value < threshold, "<=": lambda: value <= threshold, "==": lambda: near, "!=": lambda: ~near}[op]()


@dataclass(frozen=True)
class Rule:
    """A threshold rule: ``query`` makes a search from the rows of the rule's window; its last column is the value."""

    name: str
    query: Callable[[Search], Search]
    op: str = ">"
    threshold: float = 0.0
    window_s: int = 3600
    severity: int = 2
    mitre: str = ""
    enabled: bool = True
    risk_score: int = 0
    compliance: str = ""
    fields: tuple[str, ...] = attr(default=())
    #: A column and the value that every row of the rule has in it; many rules are filed under it.
    under: tuple[str, str] | None = None


#: Measures of a rule that one pass can take for all rules.
MEASURES = {"count": "n", "dc": "d", "sum": "sum", "avg": "avg", "min": "min", "max": "max"}


def _measure(df: DataFrame, r: Rule) -> tuple[Column, str, str | None] | None:
    """(test of a row, measure, column) of a rule that only filters and then takes one measure of all rows; else None."""
    s = r.query(Search(df))
    names, notes = [n for n, _ in s.stages], s.notes
    if not names or names[-1] != "stats" or set(names[:-1]) - {"search", "where"} or len(notes[-1].made) != 1:
        return None
    name, what = notes[-1].made[0]
    if notes[-1].only != (name,) or name not in MEASURES or not (what is None or isinstance(what, str)):
        return None
    if name not in ("count", "dc") and not isinstance(df.schema[what].dataType, NumericType) if what in df.columns else what is not None:
        return None
    tests = [t for n in notes[:-1] for t in n.filters]
    if not all(isinstance(t, Column) for t in tests):
        return None
    return reduce(lambda a, b: a & b, tests, F.lit(True)), name, what


def evaluate_at_once(df: DataFrame, rules: list[Rule], now: int) -> tuple[DataFrame | None, list[Rule]]:
    """(rule, value, severity, mitre, fired of the rules that one scan can measure; the other rules).

    A row gives an entry for every rule that it matches. Rules are filed under a value of a column (``under``), and a
    row tests only those under its own values and those that are filed nowhere. Entries are then summed by rule.
    """
    made = [(r, _measure(df, r)) for r in rules]
    rest, some = [r for r, m in made if m is None], [(i, r, m) for i, (r, m) in enumerate(made) if m is not None]
    if not some:
        return None, rest
    none = F.array().cast("array<struct<rule:int,text:string,number:double>>")
    filed: dict[str | None, dict[str, list[Column]]] = {}
    for i, r, (test, name, what) in some:
        hit = F.coalesce(test & F.col("ts").between(now - r.window_s, now), F.lit(False))
        text = F.lit(None).cast("string") if what is None else F.col(what).cast("string")
        number = F.lit(None).cast("double") if what is None or name in ("count", "dc") else F.col(what).cast("double")
        entry = F.when(hit, F.struct(F.lit(i).alias("rule"), text.alias("text"), number.alias("number")))
        column, value = r.under or (None, "")
        filed.setdefault(column, {}).setdefault(value, []).append(entry)
    branches = []
    for column, values in filed.items():
        if column is None:
            branches.append(F.array(*values[""]))
            continue
        case = None
        for value, entries in values.items():
            case = F.when(F.col(column) == value, F.array(*entries)) if case is None else case.when(F.col(column) == value, F.array(*entries))
        branches.append(case.otherwise(none))
    rows = df.where(F.col("ts").between(now - max(r.window_s for _, r, _ in some), now))
    found = rows.select(F.explode(F.filter(F.concat(*branches), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counts = found.groupBy("rule").agg(F.count("*").alias("n"), F.count("text").alias("c"), F.countDistinct("text").alias("d"), *[getattr(F, k)("number").alias(k) for k in ("sum", "avg", "min", "max")])
    spec = df.sparkSession.createDataFrame([(i, r.name, "c" if name == "count" and what else MEASURES[name], r.op, float(r.threshold), r.severity, r.mitre) for i, r, (_, name, what) in some], "rule int, name string, measure string, op string, least double, severity int, mitre string")
    value = F.coalesce(*[F.when(F.col("measure") == k, F.coalesce(F.col(k).cast("double"), F.lit(0.0 if k in ("n", "c", "d") else None).cast("double"))) for k in ("n", "c", "d", "sum", "avg", "min", "max")])
    out = spec.join(counts, "rule", "left").withColumn("value", value)
    fired = F.coalesce(*[F.when(F.col("op") == op, compare(F.col("value"), op, F.col("least"))) for op in (">", ">=", "<", "<=", "==", "!=")], F.lit(False))
    return out.select(F.col("name").alias("rule"), "value", "severity", "mitre", fired.alias("fired")), rest


def evaluate_rules(df: DataFrame, rules: list[Rule], now: int) -> DataFrame:
    """rule, value, severity, mitre, fired: the last column of the first row of each rule's search.

    Rules that filter and take one measure are evaluated in one scan, whatever their number; each other one has a scan of its own.
    """
    at_once, rest = evaluate_at_once(df, [r for r in rules if r.enabled], now)
    out = [] if at_once is None else [at_once]
    for r in rest:
        found = r.query(Search(df).search(start=now - r.window_s, end=now)).df
        first = found.limit(1).select(F.col(found.columns[-1]).try_cast("double").alias("value"))
        one = first.agg(F.max("value").alias("value")).select(F.lit(r.name).alias("rule"), "value", F.lit(r.severity).alias("severity"), F.lit(r.mitre).alias("mitre"), F.coalesce(compare(F.col("value"), r.op, r.threshold), F.lit(False)).alias("fired"))
        out.append(one)
    if not out:
        return df.sparkSession.createDataFrame([], "rule string, value double, severity int, mitre string, fired boolean")
    return reduce(DataFrame.unionByName, out)


def merge_alerts(alerts: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """dedup, status, ts, last_ts after a tick: new alerts, refreshed ones, and resolved ones.

    ``results`` has dedup, fired (null: the evaluation failed, which changes nothing). Only open alerts (new or
    acknowledged) meet their result; what is closed stays as it is, and its key is free for a new alert.
    """
    columns = ["dedup", "status", "ts", "last_ts"]
    is_open = F.coalesce(F.col("status").isin("new", "ack"), F.lit(False))
    old = alerts.select(*columns).where(~is_open)
    live = alerts.select(*columns, F.lit(True).alias("live")).where(is_open)
    fired = F.coalesce("fired", F.lit(False))
    # an alert without a key meets no result
    j = live.join(results.select("dedup", "fired").where("dedup is not null"), "dedup", "full")
    held = F.coalesce("live", F.lit(False))
    status = F.when(held & (F.col("fired") == F.lit(False)), "resolved").when(held, F.col("status")).when(fired, "new")
    # an open alert that fires again is fresh: its time moves on
    out = j.select("dedup", status.alias("status"), F.when(fired, F.lit(now)).otherwise(F.col("ts")).alias("ts"), F.when(fired, F.lit(now)).otherwise(F.col("last_ts")).alias("last_ts"))
    return out.where("status is not null").unionByName(old)


def blind_rules(history: DataFrame, hour: int = 3600) -> DataFrame:
    """Rules whose latest evaluations all failed, at least max(2, ceil(hour / interval)) of them.

    ``history``: rule, ts, ok, interval_s, cause.
    """
    w = Window.partitionBy("rule").orderBy(F.desc("ts"))
    runs = history.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_run = 0")
    out = runs.groupBy("rule").agg(F.count("*").alias("failed"), F.max("interval_s").alias("interval_s"), F.min("ts").alias("since"), F.max_by("cause", "ts").alias("cause"))
    return out.where(F.col("failed") >= F.greatest(F.lit(2), F.ceil(F.lit(hour) / F.col("interval_s")))).drop("interval_s")


def fire_units(result: DataFrame, per_result: bool, throttle_field: str | None = None) -> DataFrame:
    """key: one unit for each row, for each distinct value, or a single global one."""
    if throttle_field:
        return result.select(F.col(throttle_field).cast("string").alias("key")).distinct()
    if per_result:
        return result.select(F.sha2(F.to_json(F.struct(*result.columns)), 256).alias("key"))
    return result.limit(1).select(F.lit("*").alias("key"))


def suppress(units: DataFrame, last_fires: DataFrame, window: int, now: int) -> DataFrame:
    """Units that did not fire in the last ``window`` seconds."""
    recent = last_fires.where(F.col("fired_at") > now - window).select("key")
    return units.join(recent, "key", "left_anti")


def correlate_sequence(df: DataFrame, steps: list[tuple[Column, int]], key: str, start: int, end: int) -> DataFrame:
    """key, completed: entities whose events satisfy the steps in order, in [start, end].

    Each step needs its count of events at or after the time the step before was complete (16 steps at most).
    A step is one rank by key: Spark keeps the first n events of a key in each task before it shuffles, so a
    busy entity is never gathered.
    """
    if not 0 < len(steps) <= 16:
        raise ValueError("1 to 16 steps")
    window = df.where(F.col("ts").between(start, end) & F.col(key).isNotNull())
    rank, anchor = F.row_number().over(Window.partitionBy(key).orderBy("ts")), None
    for predicate, n in steps:
        rows = window.where(predicate).select(key, "ts")
        if anchor is not None:
            rows = rows.join(anchor, key).where(F.col("ts") >= F.col("completed")).select(key, "ts")
        anchor = rows.withColumn("_n", rank).where(F.col("_n") == n).select(key, F.col("ts").alias("completed"))
    return anchor


def baseline_scores(df: DataFrame, entity: str, bucket_s: int, window_s: int, min_samples: int) -> DataFrame:
    """entity, bucket, value, n, mean, sd, z of each bucket against the entity's earlier ones in the window.

    No score under two samples, under ``min_samples``, or without spread.
    """
    obs = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), bucket(F.col("ts"), bucket_s).alias("bucket")).agg(F.count("*").cast("double").alias("value"))
    w = Window.partitionBy("entity").orderBy("bucket").rangeBetween(-window_s, -1)
    out = obs.select("*", F.count("value").over(w).alias("n"), F.avg("value").over(w).alias("mean"), F.stddev_samp("value").over(w).alias("sd"))
    ok = (F.col("n") >= max(2, min_samples)) & (F.col("sd") > 0)
    return out.withColumn("z", F.when(ok, (F.col("value") - F.col("mean")) / F.when(ok, F.col("sd"))))


def baseline_anomaly(df: DataFrame, entity: str, bucket_s: int, window_s: int, min_samples: int, z: float, now: int) -> DataFrame:
    """Entities whose last closed bucket is ``z`` deviations or more above their baseline."""
    last = now // bucket_s * bucket_s - bucket_s
    return baseline_scores(df.where(F.col("ts").between(last - window_s, last + bucket_s - 1)), entity, bucket_s, window_s, min_samples).where((F.col("bucket") == last) & (F.col("z") >= z))


MAX_SOURCES = 32


def impute_sources(df: DataFrame, matched: Column) -> DataFrame:
    """sources, known: up to 32 sources that fed the matched events, in order; none is named unknown."""
    some = df.where(matched).where("source is not null").select("source").distinct().orderBy("source").limit(MAX_SOURCES)
    return some.agg(F.array_sort(F.collect_list("source")).alias("s")).select(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit("unknown"))).alias("sources"), (F.size("s") > 0).alias("known"))


def playbook_targets(found: DataFrame, seen: DataFrame, actions: DataFrame, window: int, now: int) -> DataFrame:
    """target, host: distinct values of the first column on hosts that saw the address, without those acted on in the window."""
    targets = found.select(F.col(found.columns[0]).cast("string").alias("target")).where("target <> ''").distinct()
    pairs = targets.join(seen.select(F.col("src_ip").alias("target"), "host").distinct(), "target")
    done = actions.where(F.col("ts") > now - window).select("target", "host")
    return pairs.join(done, ["target", "host"], "left_anti")


#: Labels of an alert that policies and silences may ask for.
LABELS = ("rule", "host", "mitre", "src_ip", "severity")


def _asked(settings: DataFrame, key: str) -> DataFrame:
    """key, label, value, wanted: a row for each label a policy asks for; an absent label is asked for by a null value."""
    wanted = F.filter(F.map_entries(F.coalesce("match", F.create_map().cast("map<string,string>"))), lambda x: ~(x["value"].isNull() & ~x["key"].isin(*LABELS)))
    return settings.select(key, F.explode_outer(wanted).alias("x"), F.size(wanted).alias("wanted")).select(key, "x.key", "x.value", "wanted")


def _matches(labels: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """labels, key: which settings hold for which set of labels, by counting.

    Labels and settings meet in an equi-join on (label, value); a setting holds where as many of its labels were met as it asks
    for. One that asks for nothing holds for all and is met under a label that every set has.
    """
    asked = _asked(settings, key)
    own = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("key"), F.col("labels").getField(c).alias("value")) for c in LABELS])
    text = lambda v: F.coalesce(F.concat(F.lit("="), v), F.lit("-"))  # noqa: E731  a null is a value of its own
    have = labels.select("labels", F.explode(own).alias("x")).select("labels", F.col("x.key").alias("_key"), text(F.col("x.value")).alias("_value"))
    none = F.col("wanted") == 0
    want = asked.select(key, "wanted", F.when(none, "").otherwise(F.col("key")).alias("_key"), F.when(none, "=").otherwise(text(F.col("value"))).alias("_value"))
    met = have.join(want, ["_key", "_value"]).groupBy("labels", key).agg(F.count("*").alias("met"), F.max("wanted").alias("wanted"))
    return met.where((F.col("met") == F.col("wanted")) | (F.col("wanted") == 0)).select("labels", key)


def route_alerts(alerts: DataFrame, policies: DataFrame, silences: DataFrame, now: int, channels: list[str]) -> DataFrame:
    """id, channels, silenced. Policies: id, match (map), channels (array), continue. Silences: match (map), until.

    Of the policies whose labels all match, the most specific wins (ties: smallest id); while it says
    ``continue`` (null: no) the next one adds its channels. Without a policy all channels get the alert. Policies without labels match
    every alert. Each distinct set of labels is routed once and joined back by value, so null and repeated ids keep their route.
    """
    labels = F.struct(*[F.col(c).cast("string").alias(c) for c in LABELS])
    a = alerts.select("id", labels.alias("labels"))
    sets = a.select("labels").distinct()
    # a policy is known by its content: ids may be null or repeated
    named = policies.select(F.col("id").alias("policy"), "channels", F.coalesce("continue", F.lit(False)).alias("more"), "match")
    kept = F.struct(F.coalesce(-F.size("match"), F.lit(0)).alias("o"), "policy", "channels", "more", F.array_sort(F.map_entries("match")).alias("of"))
    hits = _matches(sets, named.select(kept.alias("p"), "match"), "p")
    ranked = hits.groupBy("labels").agg(F.array_sort(F.collect_list("p")).alias("p"))
    stop = F.array_position(F.transform("p", lambda x: x["more"]), F.lit(False))
    used = F.when(stop > 0, F.slice("p", 1, stop.cast("int"))).otherwise(F.col("p"))
    routed = ranked.select("labels", F.array_sort(F.array_distinct(F.flatten(F.transform(used, lambda x: x["channels"])))).alias("channels"))
    live = silences.where(F.col("until") > now).select(F.struct("until", F.array_sort(F.map_entries("match")).alias("of")).alias("s"), "match")
    quiet = _matches(sets, live, "s").select("labels").distinct().withColumn("silenced", F.lit(True))
    every = F.array(*[F.lit(c) for c in sorted(channels)])
    out = a.join(routed, "labels", "left").join(quiet, "labels", "left")
    return out.select("id", F.coalesce("channels", every).alias("channels"), F.coalesce("silenced", F.lit(False)).alias("silenced"))


def drilldown(df: DataFrame, rule: Rule, ts: int) -> DataFrame:
    """Rows behind an alert: the rule's stages on its window, without the trailing aggregation."""
    s = Search(df).search(start=ts - rule.window_s, end=ts)
    stages = rule.query(s).stages[len(s.stages) :]
    shaping = ("stats", "top", "rare", "timechart", "rate")
    last = max((i for i, (name, _) in enumerate(stages) if name in shaping), default=len(stages))
    first = min((i for i, (name, _) in enumerate(stages) if name in shaping), default=last)
    out = s.df
    for _, step in stages[:first]:
        out = step(out)
    return out
