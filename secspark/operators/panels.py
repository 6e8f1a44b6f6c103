"""Analytics panels over alerts, rules, cases, feeds and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.functions.predicates import all_of
from secspark.functions.scalar import compliance_pairs, hour_floor, parent_technique, techniques
from secspark.model import DEFAULT_ENV

DAY = 86400
OPEN = ("new", "ack")


# P1 to P5: alerts
def alert_groups(alerts: DataFrame, by: str) -> DataFrame:
    """By rule, mitre, host or dedup: n, first, last, severity, open, newest title and id (of one second the smallest id); no host is ''."""
    key = F.coalesce(F.col(by), F.lit("")).alias("key")
    newest = F.struct(F.col("ts"), -F.col("id"))
    return alerts.groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("severity").alias("max_severity"), F.count_if(F.col("status").isin(*OPEN)).alias("open"), F.max_by("title", newest).alias("title"), F.max_by("id", newest).alias("last_id"))


def filter_alerts(alerts: DataFrame, status: str | None = None, technique: str | None = None, source: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """By status, technique (a parent matches its children), exactly imputed source, and without those in a case."""
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if technique:
        tests.append(F.exists(techniques(F.col("mitre")), lambda t: (t == technique) | (parent_technique(t) == technique)))
    if source:
        tests.append(F.array_contains(F.split("sources", "\n"), source))
    out = alerts.where(all_of(tests))
    if items is not None:
        from secspark.operators.search import uncased

        out = uncased(out, items)
    return out


def technique_detections(alerts: DataFrame, since: int) -> DataFrame:
    """technique, n, first_ts of alerts; a tag that can't be read stays as it is."""
    t = techniques(F.col("mitre"))
    rows = alerts.where(F.col("ts") >= since).select("ts", F.explode(F.when(F.size(t) > 0, t)).alias("technique"))
    return rows.groupBy("technique").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def attack_matrix(rules: DataFrame, alerts: DataFrame, catalog: DataFrame) -> DataFrame:
    """tactic, technique, rules, alerts, covered for every catalogue entry (tactic, technique); others are 'unmapped'."""
    t = lambda d, n: d.select(F.explode(F.array_distinct(F.transform(techniques(F.col("mitre")), parent_technique))).alias("technique")).groupBy("technique").agg(F.count("*").alias(n))
    counts = t(rules.where("enabled"), "rules").join(t(alerts, "alerts"), "technique", "full")
    j = catalog.join(counts, "technique", "full")
    return j.select(F.coalesce("tactic", F.lit("unmapped")).alias("tactic"), "technique", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("alerts", F.lit(0)).alias("alerts"), (F.coalesce("rules", F.lit(0)) > 0).alias("covered"))


def scoped_detections(alerts: DataFrame, events: DataFrame, engagement: str, start: int, end: int) -> DataFrame:
    """Techniques of alerts in an engagement's window whose address the tagged events show."""
    seen = events.where((F.col("engagement_id") == engagement) & F.col("ts").between(start, end)).select("src_ip")
    return technique_detections(alerts.where(F.col("ts").between(start, end)).join(seen, "src_ip", "left_semi"), start)


# P6, P7: compliance
def _pairs(df: DataFrame, column: str, framework: str | None = None) -> DataFrame:
    p = compliance_pairs(F.col(column))
    if framework:
        p = F.when(F.size(p) > 0, p).otherwise(F.array(F.struct(F.col(framework).alias("framework"), F.lit(None).cast("string").alias("control"))))
    return df.withColumn("_p", F.explode(p)).withColumns({"framework": F.col("_p.framework"), "control": F.coalesce(F.col("_p.control"), F.lit(""))}).drop("_p").where("framework <> ''")


def compliance_posture(checks: DataFrame) -> DataFrame:
    """framework, control, passed, failed, na; a check without controls counts for its framework."""
    r = F.lower("posture_result")
    return _pairs(checks, "posture_compliance", "posture_framework").groupBy("framework", "control").agg(F.count_if(r.isin("pass", "passed")).alias("passed"), F.count_if(r.isin("fail", "failed")).alias("failed"), F.count_if(~r.isin("pass", "passed", "fail", "failed") | r.isNull()).alias("na"))


def compliance_coverage(rules: DataFrame, posture: DataFrame) -> DataFrame:
    """framework, control, rules, failed, state (monitored, finding, both or none)."""
    a = _pairs(rules.where("enabled"), "compliance").groupBy("framework", "control").agg(F.count("*").alias("rules"))
    j = a.join(posture.select("framework", "control", "failed"), ["framework", "control"], "full")
    n, f = F.coalesce("rules", F.lit(0)), F.coalesce("failed", F.lit(0))
    state = F.when((n > 0) & (f > 0), "both").when(n > 0, "monitored").when(f > 0, "finding").otherwise("none")
    return j.select("framework", "control", n.alias("rules"), f.alias("failed"), state.alias("state"))


# P8, P9, P18: feeds and sensors
def feed_status(age: Column, interval: Column, recent: Column) -> Column:
    """muted: over 5 intervals; late: over 2; calm: nothing in 24 hours; else fresh."""
    return F.when(recent == 0, F.when(age > 5 * interval, "muted").otherwise("calm")).when(age > 5 * interval, "muted").when(age > 2 * interval, "late").otherwise("fresh")


def freshness(events: DataFrame, snapshots: DataFrame, metrics: DataFrame, cadence: DataFrame, now: int) -> DataFrame:
    """feed, kind, last_ts, n_24h, interval_s, age, status. Cadence (feed, interval_s) wins over what was observed.

    A snapshot feed is as old as its slowest host.
    """
    recent = F.count_if(F.col("ts") > now - DAY).alias("n_24h")
    seen = lambda d, key, kind: d.groupBy(F.col(key).alias("feed")).agg(F.max("ts").alias("last_ts"), recent, ((F.max("ts") - F.min("ts")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("observed")).withColumn("kind", F.lit(kind))
    hosts = snapshots.groupBy("kind", "host").agg(F.max("ts").alias("_last"), F.count_if(F.col("ts") > now - DAY).alias("_n"), F.min("ts").alias("_first"), F.count("*").alias("_all"))
    snap = hosts.groupBy(F.col("kind").alias("feed")).agg(F.min("_last").alias("last_ts"), F.sum("_n").alias("n_24h"), ((F.max("_last") - F.min("_first")) / F.greatest(F.max("_all") - 1, F.lit(1))).alias("observed")).withColumn("kind", F.lit("snapshot"))
    every = seen(events, "source", "event").unionByName(seen(metrics, "name", "metric")).unionByName(snap)
    out = every.join(cadence, "feed", "left").withColumn("interval_s", F.coalesce(F.col("interval_s").cast("double"), F.col("observed")))
    age = F.lit(now) - F.col("last_ts")
    return out.select("feed", "kind", "last_ts", "n_24h", "interval_s", age.alias("age"), feed_status(age, F.col("interval_s"), F.col("n_24h")).alias("status"))


def heartbeats(feeds: DataFrame, sensors: DataFrame, now: int) -> DataFrame:
    """sensor, state. Sensors: sensor, feed, interval_s, event_driven, pipeline (feed an event-driven one depends on)."""
    last = feeds.select("feed", "last_ts")
    pipe = feeds.select(F.col("feed").alias("pipeline"), F.col("last_ts").alias("_pipe"))
    j = sensors.join(last, "feed", "left").join(pipe, "pipeline", "left")
    heard = F.when(F.col("event_driven"), F.greatest("last_ts", "_pipe")).otherwise(F.col("last_ts"))
    state = F.when(heard.isNull(), "unknown").when(F.lit(now) - heard <= 5 * F.col("interval_s"), "active").otherwise("muted")
    return j.select("sensor", state.alias("state"), heard.alias("last_ts"))


def source_inventory(events: DataFrame, expected: DataFrame, now: int) -> DataFrame:
    """source, expected, last_ts, n_24h, status: seen in 7 days (3 events at least) against the declared sources."""
    seen = events.where(F.col("ts") > now - 7 * DAY).groupBy("source").agg(F.max("ts").alias("last_ts"), F.count_if(F.col("ts") > now - DAY).alias("n_24h"), F.count("*").alias("_n"), F.min("ts").alias("_first")).where("_n >= 3")
    j = seen.join(expected.select("source", F.lit(True).alias("_e")), "source", "full")
    interval = (F.col("last_ts") - F.col("_first")) / F.greatest(F.col("_n") - 1, F.lit(1))
    status = F.when(F.col("last_ts").isNull(), "dormant").otherwise(feed_status(F.lit(now) - F.col("last_ts"), interval, F.col("n_24h")))
    return j.select("source", F.coalesce("_e", F.lit(False)).alias("expected"), "last_ts", F.coalesce("n_24h", F.lit(0)).alias("n_24h"), status.alias("status"))


# P10, P11: hosts
FRESH, STALE = 900, 3600


def fleet(host_rollup: DataFrame, enrolled: DataFrame, now: int) -> DataFrame:
    """host, age, state (fresh, stale, silent), enrolled; enrolled hosts that were never heard are silent."""
    h = host_rollup.groupBy("host").agg(F.max("last_ts").alias("last_ts"), F.sum("sig_total").alias("signals"))
    j = h.join(enrolled.select("host", F.lit(True).alias("_e")), "host", "full")
    age = F.lit(now) - F.col("last_ts")
    return j.select("host", "last_ts", age.alias("age"), F.when(age <= FRESH, "fresh").when(age <= STALE, "stale").otherwise("silent").alias("state"), F.coalesce("_e", F.lit(False)).alias("enrolled"), F.coalesce("signals", F.lit(0)).alias("signals"))


def silent_fleet(host_rollup: DataFrame, now: int, silent_s: int = STALE, worst: int = 5) -> DataFrame:
    """expected, silent, worst hosts, and a fingerprint of the silent set.

    The fingerprint adds up hashes of host names, so the set is never gathered in one place.
    """
    h = host_rollup.groupBy("host").agg(F.max("last_ts").alias("last_ts")).withColumn("_s", F.lit(now) - F.col("last_ts") > silent_s)
    total = h.agg(F.count("*").alias("expected"), F.count_if("_s").alias("silent"), F.sha2(F.concat_ws("|", F.coalesce(F.bit_xor(F.when(F.col("_s"), F.xxhash64("host"))), F.lit(0)).cast("string"), F.count_if("_s").cast("string")), 256).alias("fingerprint"))
    top = h.where("_s").orderBy("last_ts", "host").limit(worst).agg(F.transform(F.array_sort(F.collect_list(F.struct("last_ts", "host"))), lambda x: x["host"]).alias("worst"))
    return total.crossJoin(top)  # a single row each


# P12, P13, P19
def attackers(df: DataFrame, sources: list[str], least: int = 20) -> DataFrame:
    """src_ip, hits: addresses with more than ``least`` hits over the given sources."""
    return df.where(F.col("source").isin(sources) & (F.col("src_ip") != "")).groupBy("src_ip").agg(F.count("*").alias("hits")).where(F.col("hits") > least)


def unmitigated(df: DataFrame, banned: DataFrame, sources: list[str], least: int = 20) -> DataFrame:
    return attackers(df, sources, least).join(banned, "src_ip", "left_anti")


def ban_coverage(df: DataFrame, banned: DataFrame, sources: list[str], least: int = 20) -> DataFrame:
    """attackers, banned, percent."""
    j = attackers(df, sources, least).join(banned.select("src_ip").distinct().withColumn("_b", F.lit(True)), "src_ip", "left")
    return j.agg(F.count("*").alias("attackers"), F.count("_b").alias("banned")).withColumn("percent", F.when(F.col("attackers") > 0, F.round(F.col("banned") * 100.0 / F.col("attackers"), 1)))


def overview(events: DataFrame, alerts: DataFrame, cases: DataFrame, now: int) -> DataFrame:
    """A single row of headline counts."""
    e = events.agg(F.count_if(F.col("ts") > now - DAY).alias("events_24h"), F.countDistinct(F.when(F.col("ts") > now - DAY, F.col("host"))).alias("hosts_24h"))
    a = alerts.agg(F.count_if(F.col("status").isin(*OPEN)).alias("open_alerts"), F.count_if(F.col("status").isin(*OPEN) & (F.col("severity") >= 3)).alias("open_high"))
    c = cases.agg(F.count_if(~F.col("status").isin("closed", "resolved")).alias("open_cases"))
    return e.crossJoin(a).crossJoin(c)  # a single row each


def environments(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce(F.nullif("env_id", F.lit("")), F.lit(DEFAULT_ENV)).alias("env_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def ioc_coverage(iocs: DataFrame, now: int) -> DataFrame:
    """type, source, total, active, expired; null keys are the totals over all."""
    live = F.col("expires").isNull() | (F.col("expires") == 0) | (F.col("expires") > now)
    return iocs.groupingSets([["type"], ["source"], []], "type", "source").agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("expired"))


# P14 to P16: cases. Default targets in seconds by priority 1 to 4 (acknowledge, resolve).
SLA_TARGETS = {1: (900, 14400), 2: (3600, 28800), 3: (14400, 86400), 4: (28800, 259200)}
CLOSED = ("closed", "resolved")


def case_queues(cases: DataFrame, now: int) -> DataFrame:
    """Per assignee: open, overdue, acknowledgement pending, breached, waiting."""
    c = cases.where(~F.col("archived") & F.col("merged_into").isNull() & ~F.col("status").isin(*CLOSED))
    return c.groupBy(F.coalesce("assignee", F.lit("")).alias("assignee")).agg(F.count("*").alias("open"), F.count_if(F.col("resolve_due") < now).alias("overdue"), F.count_if(F.col("first_response_ts").isNull()).alias("ack_pending"), F.count_if(F.col("ack_breached") | F.col("resolve_breached")).alias("breached"), F.count_if(F.col("status") == "waiting").alias("waiting"))


def _upper_median(c: Column) -> Column:
    a = F.array_sort(F.collect_list(c))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def case_metrics(cases: DataFrame, start: int, end: int) -> DataFrame:
    """Per assignee and overall (null): cases, mean and upper median of time to acknowledge and to resolve (pauses off), breaches.

    The median is exact and grouped in two steps: values are counted first, so one group holds distinct
    durations at most.
    """
    c = cases.where(F.col("ts").between(start, end)).withColumns({"mtta": F.col("first_response_ts") - F.col("ts"), "mttr": F.col("closed_ts") - F.col("ts") - F.coalesce("sla_pause_accum", F.lit(0)), "assignee": F.coalesce("assignee", F.lit(""))})
    breach = F.count_if(F.col("ack_breached") | F.col("resolve_breached")).alias("breaches")
    base = c.groupingSets([["assignee"], []], "assignee").agg(F.count("*").alias("cases"), F.avg("mtta").alias("mtta_mean"), F.avg("mttr").alias("mttr_mean"), breach)

    def median(column: str) -> DataFrame:
        n = c.where(F.col(column).isNotNull()).groupingSets([["assignee", column], [column]], "assignee", column).agg(F.count("*").alias("_n"))
        w = Window.partitionBy("assignee")
        run = F.sum("_n").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        at = F.floor(F.sum("_n").over(w) / 2)
        hit = n.withColumns({"_run": run, "_at": at}).where(F.col("_run") > F.col("_at"))
        return hit.groupBy(F.col("assignee").alias("_k")).agg(F.min(column).alias(f"{column}_p50"))

    out = base
    for m in (median("mtta"), median("mttr")):
        out = out.join(m, out["assignee"].eqNullSafe(m["_k"]), "left").drop("_k")
    return out.select("assignee", "cases", "mtta_mean", "mtta_p50", "mttr_mean", "mttr_p50", "breaches")


def sla_deadlines(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """Cases with ack_due and resolve_due: opening, target and pauses. Policies: priority, ack_s, resolve_s."""
    table = lambda i: F.create_map(*[F.lit(x) for k, v in SLA_TARGETS.items() for x in (k, v[i])])[F.col("priority")]
    j = cases.drop("ack_due", "resolve_due").join(policies, "priority", "left")
    pause = F.coalesce("sla_pause_accum", F.lit(0))
    return j.withColumns({"ack_due": F.col("ts") + F.coalesce("ack_s", table(0)) + pause, "resolve_due": F.col("ts") + F.coalesce("resolve_s", table(1)) + pause}).drop("ack_s", "resolve_s")


def sla_breaches(cases: DataFrame, now: int) -> DataFrame:
    """id, breach (ack or resolve) of cases past their time; a paused case breaches nothing."""
    running = F.col("sla_paused_since").isNull()
    late_ack = F.coalesce("first_response_ts", F.lit(now)) > F.col("ack_due")
    late = F.coalesce("closed_ts", F.lit(now)) > F.col("resolve_due")
    kinds = F.filter(F.array(F.when(late_ack & (running | F.col("first_response_ts").isNotNull()), "ack"), F.when(late & (running | F.col("closed_ts").isNotNull()), "resolve")), lambda x: x.isNotNull())
    return cases.select("id", F.explode(kinds).alias("breach"))


# P17: metrics by selector
def select_series(metrics: DataFrame, name: str | None, matchers: dict[str, str]) -> DataFrame:
    labels = F.coalesce(F.from_json("labels", "map<string,string>"), F.create_map().cast("map<string,string>"))
    out = metrics.withColumn("_l", labels)
    tests = ([F.col("name") == name] if name else []) + [F.coalesce(F.col("_l")[k], F.lit("")) == v for k, v in matchers.items()]
    return out.where(all_of(tests))


def prom_instant(metrics: DataFrame, name: str, matchers: dict[str, str], at: int, lookback: int = 300) -> DataFrame:
    """Last sample of each series in the lookback."""
    s = select_series(metrics.where((F.col("ts") > at - lookback) & (F.col("ts") <= at)), name, matchers)
    return s.groupBy("name", "labels", "host").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def prom_range(metrics: DataFrame, name: str, matchers: dict[str, str], start: int, end: int) -> DataFrame:
    """Raw samples in a range, a row each: a long series is never gathered into one value."""
    return select_series(metrics.where(F.col("ts").between(start, end)), name, matchers).select("name", "labels", "host", "ts", "value")


def prom_labels(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.explode(F.map_keys(F.from_json("labels", "map<string,string>"))).alias("label")).distinct()


def label_values(metrics: DataFrame, label: str) -> DataFrame:
    return metrics.select(F.from_json("labels", "map<string,string>")[label].alias("value")).where("value is not null").distinct()


def series(metrics: DataFrame, name: str | None, matchers: dict[str, str]) -> DataFrame:
    return select_series(metrics, name, matchers).select("name", "labels", "host").distinct()


# P20
def report_rows(search, masks: dict[str, str], salt: str = "", n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(number of rows, first rows) of a search run under a role's masks: the newest where rows have a time, else by their columns.

    A search that filters by a masked field is refused with PermissionError.
    """
    from secspark.operators.govern import under_masks

    rows = under_masks(search, masks, salt)
    order = [F.desc(c) for c in ("ts", "id") if c in rows.columns] or [F.col(f"`{c}`") for c in rows.columns]
    return rows.agg(F.count("*").alias("rows")), rows.orderBy(*order).limit(n)
