"""The shipped rules as data for the rule evaluator.

Only the two values that start with the reserved source name stand for others: ``de-detection-content-mutated``
reads this library's own source, and the key of ``co-sensitive-cred-access`` is a neutral one.

A rule counts rows, or the groups whose count or number of distinct values is over a limit. Fields that are no
columns are read from the bag. Rules that are off by default are there to be switched on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.model import RESERVED_SOURCE
from secspark.operators.detect import Rule, compare
from secspark.operators.normalize import json_map

COLUMNS = ("source", "category", "severity", "host", "message", "src_ip", "dst_ip", "url")

# Name, tests, group by, (what, limit), threshold test, window, severity, technique, on by default.
# A test "field>=" is numeric, "field!=" is inequality, a list is any of its values, "" is text in the message.
# what is "count" or the field whose distinct values count; without a group it is the value itself.
TABLE = [
    ("cf-recon-low-and-slow", {"source": "cloudflare"}, "src_ip", ("path", 5), "> 0", 3600, 3, "T1595.002", True),
    ("example-custom", {"source": "nginx", "status>=": 500}, "src_ip", ("count", 20), "> 0", 600, 3, "T1190", False),
    ("fw-denied-portscan-any-vendor", {"category": "firewall", "action": "deny"}, "src_ip", ("dst_port", 50), "> 0", 1800, 3, "T1046", False),
    ("fw-horizontal-scan-low-and-slow", {"category": "firewall", "action": "deny"}, "src_ip", ("dst_ip", 5), "> 0", 3600, 3, "T1046", True),
    ("fw-malware-blocked-any-vendor", {"category": "malware", "action": "blocked"}, None, ("count", None), "> 0", 900, 4, "T1105", False),
    ("fw-portscan-low-and-slow", {"category": "firewall", "action": "deny"}, "src_ip", ("dst_port", 8), "> 0", 3600, 3, "T1046", True),
    ("portprobe-low-and-slow", {"source": "portprobe"}, "src_ip", ("count", 12), "> 0", 3600, 2, "T1046", True),
    ("t1190-web-exploit-5xx-burst", {"category": "web", "status>=": 500}, "src_ip", ("path", 8), "> 0", 1800, 3, "T1190", True),
    ("t1190-web-exploit-blocked", {"action": "blocked", "": "http"}, "src_ip", ("count", 0), "> 0", 900, 4, "T1190", True),
    ("web-scan-404-breadth-cf", {"source": "cloudflare-http", "status": "404"}, "src_ip", ("path", 30), "> 0", 1800, 3, "T1595.002", True),
    ("ca-cred-distributed-bruteforce", {"category": "auth", "action": "failure"}, None, ("src_ip", None), "> 0", 900, 2, "T1110", False),
    ("ca-cred-mail-bruteforce", {"source": "mail", "action": "failure"}, "src_ip", ("count", 15), "> 0", 900, 3, "T1110", False),
    ("ca-cred-password-spray-auditd", {"source": "auditd", "category": "auth", "action": "failure"}, "src_ip", ("acct", 5), "> 0", 1800, 3, "T1110.003", False),
    ("ca-cred-web-login-bruteforce", {"source": "web", "status": "401"}, "src_ip", ("count", 20), "> 0", 900, 3, "T1110", False),
    ("ca-ssh-authkeys-persistence", {"source": "integrity", "kind": "authkeys"}, None, ("count", None), "> 0", 3600, 4, "T1098.004", False),
    ("cl-kube-anonymous-access", {"source": "kube-audit", "user": "*anonymous"}, None, ("count", None), "> 0", 900, 3, "T1078", False),
    ("cl-minio-public-bucket", {"source": "minio", "kind": "bucket", "risk": "public"}, None, ("count", None), "> 0", 3600, 3, "T1530", False),
    ("co-sensitive-cred-access", {"source": "dataaccess", "key": "service_creds", "action": "read"}, "user", ("count", 5), "> 0", 1800, 3, "T1552.001", False),
    ("de-auditd-disabled", {"source": "auditd", "category": "exec", "exe": "*auditctl*"}, None, ("count", None), "> 0", 1800, 4, "T1562.001", False),
    ("de-auditd-no-exec-rule", {"source": "auditd", "category": "config", "exec_rule_b64": "0"}, None, ("count", None), "> 0", 7200, 2, "T1562.001", False),
    ("de-auditd-silent", {"source": "auditd"}, None, ("count", None), "< 1", 600, 4, "T1562.001", False),
    ("de-collector-unavailable", {"category": "config", "collect_status": "unavailable"}, None, ("count", None), "> 0", 7200, 2, "T1562.001", False),
    ("de-detection-content-mutated", {"source": RESERVED_SOURCE + "config", "category": "config", "kind": ["rule", "parser"]}, None, ("count", None), "> 0", 1800, 2, "T1562.001", True),
    ("di-conntrack-internal-sweep", {"source": "conntrack", "scope": "internal", "dir": "outbound"}, "src_ip", ("dst_ip", 20), "> 0", 1800, 3, "T1046", False),
    ("di-kube-forbidden-burst", {"source": "kube-audit", "action": "forbidden"}, "user", ("count", 15), "> 0", 900, 3, "T1069", False),
    ("di-minio-denied-recon", {"source": "minio-audit", "status": "AccessDenied"}, "accessKey", ("count", 10), "> 0", 1800, 2, "T1526", False),
    ("ex-egress-fanout-external", {"source": "conntrack", "dir": "outbound", "scope": "external", "proc!=": ["k3s-server", "containerd"]}, "proc", ("dst_ip", 50), "> 0", 1800, 2, "T1071", False),
    ("ex-falco-runtime", {"source": "falco", "category": "ebpf", "severity>=": 3}, None, ("count", None), "> 0", 900, 3, "T1059", False),
    ("ex-host-exec-from-tmp", {"source": "auditd", "category": "exec", "exe": ["/tmp/*", "/dev/shm/*", "/var/tmp/*", "/run/*"]}, None, ("count", None), "> 0", 900, 3, "T1059.004", False),
    ("ex-ids-suricata-alert", {"source": "suricata", "category": "alert", "severity>=": 3}, None, ("count", None), "> 0", 900, 3, "T1190", False),
    ("ex-mail-mass-outbound", {"source": "mail", "category": "mailflow"}, "sender", ("count", 200), "> 0", 1800, 2, "T1048", False),
    ("ex-minio-mass-get", {"source": "minio-audit", "api": "GetObject"}, "accessKey", ("count", 500), "> 0", 1800, 3, "T1530", False),
    ("ex-webshell-post-script", {"source": "web", "method": "POST", "status": "200", "path": "*.php"}, "src_ip", ("count", 3), "> 0", 900, 3, "T1505.003", False),
    ("im-ban-storm", {"category": "ban"}, None, ("src_ip", None), "> 0", 900, 2, "T1595", False),
    ("im-fim-mass-delete", {"category": "integrity", "fim_event": "deleted"}, "agent_name", ("count", 50), "> 0", 900, 4, "T1485", False),
    ("im-fim-ransomware-modify", {"category": "integrity", "fim_event": "modified"}, "agent_name", ("count", 100), "> 0", 900, 4, "T1486", False),
    ("im-kube-mass-delete", {"source": "kube-audit", "verb": "delete", "action": "allowed"}, "user", ("count", 15), "> 0", 900, 3, "T1485", False),
    ("lm-conntrack-internal-ssh", {"source": "conntrack", "scope": "internal", "dir": "outbound", "dport": "22"}, "src_ip", ("dst_ip", 5), "> 0", 1800, 3, "T1021.004", False),
    ("pe-kube-rolebinding-created", {"source": "kube-audit", "resource": "*rolebindings", "verb": "create"}, None, ("count", None), "> 0", 1800, 3, "T1098", False),
    ("pe-kube-sa-clusteradmin", {"source": "kube-rbac", "role": "cluster-admin", "kind": "ServiceAccount"}, None, ("count", None), "> 0", 3600, 4, "T1098", False),
    ("pe-new-suid-added", {"source": "integrity", "kind": "suid", "change": "ajout"}, None, ("count", None), "> 0", 3600, 4, "T1548.001", False),
    ("pe-os-account-created", {"source": "auditd", "category": "account"}, None, ("count", None), "> 0", 1800, 3, "T1136.001", False),
    ("re-web-403-breadth", {"source": "web", "action": "blocked", "status": "403"}, "src_ip", ("path", 20), "> 0", 1800, 2, "T1595.003", False),
    ("re-web-exploit-path", {"source": "web", "path": "*etc/passwd*"}, "src_ip", ("count", 0), "> 0", 900, 3, "T1190", False),
    ("re-web-scanner-ua", {"source": "web", "ua": "*sqlmap*"}, "src_ip", ("count", 0), "> 0", 900, 2, "T1595.002", False),
]


def canonical_rules(df: DataFrame) -> DataFrame:
    """``df`` with every column that the rules refer to; missing ones are read from the bag. The bag is read once, as the map ``_bag``."""
    fields = F.col("fields") if "fields" in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({"fields": fields, "_bag": json_map(fields)})
    return rows.withColumns({c: F.col("_bag")[c].try_cast("int" if c == "severity" else "string") for c in COLUMNS if c not in df.columns})


def _value(name: str) -> Column:
    return F.col(name) if name in COLUMNS else F.col("_bag")[name]


def _test(key: str, value) -> Column:
    if key == "":
        return P.free_text(value)
    if key.endswith(">="):
        return P.ge(_value(key[:-2]), value)
    if key.endswith("!="):
        return P.all_of([P.ne(_value(key[:-2]), v) for v in value])
    return P.any_of([P.eq(_value(key), v) for v in (value if isinstance(value, list) else [value])])


def _query(tests: dict, by: str | None, what: str, limit: int | None):
    def run(s):
        s = s.search(*[_test(k, v) for k, v in tests.items()])
        made = F.count("*") if what == "count" else F.countDistinct(_value(what))
        if by is None:
            return s.stats(made.alias("value"))
        return s.eval(_by=_value(by)).stats(made.alias("value"), by=["_by"]).where(F.col("value") > limit).stats("count")

    return run


def _rule(name, tests, by, measure, threshold, window, severity, mitre, enabled) -> Rule:
    op, n = threshold.split()
    return Rule(name, _query(tests, by, *measure), op, float(n), window, severity, mitre, enabled)


LIBRARY = [_rule(*row) for row in TABLE]
ENABLED = [r for r in LIBRARY if r.enabled]


def evaluate_library(df: DataFrame, now: int, names: list[str] | None = None, absent_differs: bool = False) -> DataFrame:
    """rule, value, severity, mitre, fired of the shipped rules (those on by default, or ``names``), in one pass.

    Each row gives an entry for every rule that it matches; entries are counted by rule and group, then by rule. Rows without
    a field don't meet an inequality on it, as in a search; with ``absent_differs`` they do.
    """
    used = [r for r in TABLE if (r[8] if names is None else r[0] in names)]
    rows = canonical_rules(df).where(F.col("ts").between(now - max(r[5] for r in used), now))
    entries = []
    for name, tests, by, (what, _), _, window, *_ in used:
        met = [_test(k, v) | _value(k[:-2]).isNull() if absent_differs and k.endswith("!=") else _test(k, v) for k, v in tests.items()]
        hit = P.all_of([F.col("ts") >= now - window, *met])
        text = lambda x: F.lit(None).cast("string") if x in (None, "count") else _value(x).cast("string")
        entries.append(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("rule"), text(by).alias("group"), text(what).alias("what"))))
    found = rows.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counts = found.groupBy("rule", "group").agg(F.count("*").alias("n"), F.countDistinct("what").alias("d"))
    spec = df.sparkSession.createDataFrame(
        [(name, what == "count", by is not None, limit if by is not None else None, *threshold.split(), severity, mitre) for name, _, by, (what, limit), threshold, _, severity, mitre, _ in used],
        "rule string, rows boolean, grouped boolean, most int, op string, least string, severity int, mitre string",
    )  # a row for each rule
    measured = counts.join(F.broadcast(spec.select("rule", "rows", "grouped", "most")), "rule").withColumn("v", F.when(F.col("rows"), F.col("n")).otherwise(F.col("d")))
    values = measured.groupBy("rule").agg(F.sum(F.when(F.col("grouped"), (F.col("v") > F.col("most")).cast("long")).otherwise(F.col("v"))).alias("value"))
    out = spec.join(values, "rule", "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    fired = F.coalesce(*[F.when(F.col("op") == op, compare(F.col("value"), op, F.col("least").cast("double"))) for op in (">", ">=", "<", "<=", "==", "!=")])
    return out.select("rule", "value", "severity", "mitre", fired.alias("fired"))


def switched_on(*names: str) -> list[Rule]:
    """The given rules, whatever their default."""
    from dataclasses import replace

    return [replace(r, enabled=True) for r in LIBRARY if r.name in names]
