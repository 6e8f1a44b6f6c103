"""Normalisation and enrichment: lazy column expressions over event rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from re._parser import parse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.functions.predicates import all_of, any_of, java_pattern, octet_prefix
from secspark.functions.scalar import unused
from secspark.model import DEFAULT_ENV, RESERVED_SOURCE
from secspark.vocabulary import CATEGORIES, MODEL_VERSION

BAG = "map<string,string>"
#: A scope over so many days or more stands under one key for all days.
SCOPE_DAYS = 400
MAX_MESSAGE, MAX_KEYS, MAX_VALUE = 8192, 24, 256
# Fields that may hold an indicator, in the order they are tried.
IOC_FIELDS = ["domain", "dns_query", "query", "url", "md5", "sha1", "sha256", "hash", "src_ip", "dst_ip"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unique(m: Column) -> Column:
    """A map that was read from JSON with one entry for each key: of a repeated key the last one stays."""

    def last(x: Column) -> Column:
        keys = F.reverse(F.map_keys(x))
        return F.map_from_entries(F.filter(F.map_entries(x), lambda e, i: F.array_position(keys, e["key"]) == F.size(x) - i))

    return let(m, lambda x: F.when(F.size(F.array_distinct(F.map_keys(x))) == F.size(x), x).otherwise(last(x)))


def json_members(text: Column) -> Column:
    """A JSON object's members that aren't null, read in one pass; of a repeated one the first stands under its key, as with JSON paths. Null if unreadable."""
    # the options make it read the texts that JSON paths read
    members = F.from_json(text, BAG, {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"})
    return F.map_filter(members, lambda k, v: v.isNotNull())


def json_map(text: Column) -> Column:
    """A JSON object as a map without repeated keys; empty if absent or unreadable."""
    return F.coalesce(unique(F.from_json(text, BAG)), F.create_map().cast(BAG))


def bag(column: str = "fields") -> Column:
    """The JSON bag as a map; empty if absent or unreadable."""
    return json_map(F.col(column))


def to_bag(m: Column) -> Column:
    """A map as JSON text; null if empty."""
    return let(m, lambda x: F.when(F.size(x) > 0, F.to_json(x)))


def merge(old: Column, new: Column) -> Column:
    """Entries of both maps; the old map's values win, nulls are left out."""

    def made(both: Column) -> Column:
        # both maps are computed once, not anew for each entry
        had = both["old"]
        fresh = F.map_filter(both["new"], lambda k, v: v.isNotNull() & ~F.coalesce(F.map_contains_key(had, k), F.lit(False)))
        return F.map_concat(had, fresh)

    return let(F.struct(old.alias("old"), new.alias("new")), made)


def group_names(pattern: str) -> list[tuple[str, int]]:
    """Named groups of a Java pattern with their numbers."""
    found, n = [], 0
    for m in re.finditer(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<([A-Za-z]\w*)>", pattern):
        n += 1
        if m[1]:
            found.append((m[1], n))
    return found


def captured(text: Column, pattern: str, names: list[str] | None = None) -> Column:
    """Map of a pattern's named groups; empty where it doesn't match."""
    java = java_pattern(pattern)
    groups = [(k, i) for k, i in group_names(java) if names is None or k in names]
    if not groups:
        return F.create_map().cast(BAG)
    made = F.create_map(*[x for k, i in groups for x in (F.lit(k), F.nullif(F.regexp_extract(text, java, i), F.lit("")))])
    return F.when(F.coalesce(text.rlike(java), F.lit(False)), F.map_filter(made, lambda k, v: v.isNotNull())).otherwise(F.create_map().cast(BAG))


def apply_regex_parsers(df: DataFrame, parsers: list[tuple[str, str]]) -> DataFrame:
    """Named groups of each (source or ``*``, pattern) go into the bag; what is there is never overwritten."""
    text, m = F.substring("message", 1, MAX_MESSAGE), bag()
    for source, pattern in parsers:
        found = captured(text, pattern)
        m = merge(m, found if source == "*" else F.when(F.col("source") == source, found).otherwise(F.create_map().cast(BAG)))
    return df.withColumn("fields", to_bag(m))


def key_values(text: Column) -> Column:
    """Map of ``k=v`` and ``k="v"`` pairs: at most MAX_KEYS, the first of a key stays, values are cut."""
    pattern = r'[A-Za-z_][\w.-]*=(?:"(?:[^"\\]|\\.)*"|[^\s,;]+)'
    key = lambda x: F.substring_index(x, "=", 1)

    def entry(x: Column) -> Column:
        value = F.substr(x, F.length(key(x)) + 2)
        return F.struct(key(x).alias("key"), F.substring(F.regexp_replace(value, r'^"|"$', ""), 1, MAX_VALUE).alias("value"))

    def made(found: Column) -> Column:
        # the pattern runs once over a text, and keys are taken out once
        first = let(F.transform(found, key), lambda keys: F.filter(found, lambda x, i: F.array_position(keys, key(x)) == i + 1))
        return F.map_from_entries(F.transform(F.slice(first, 1, MAX_KEYS), entry))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made), F.create_map().cast(BAG))


def json_values(text: Column) -> Column:
    """Map of a JSON object's first MAX_KEYS members; empty if the text isn't one."""
    m = json_map(F.when(F.ltrim(text).startswith("{"), text))
    entries = F.slice(F.map_entries(m), 1, MAX_KEYS)
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"].alias("key"), F.substring(x["value"], 1, MAX_VALUE).alias("value"))))


def extract_generic(df: DataFrame, sources: list[str]) -> DataFrame:
    """JSON first, else key=value pairs, for the sources that ask for it."""
    text = F.substring("message", 1, MAX_MESSAGE)
    found = json_values(text)
    found = F.when(F.size(found) > 0, found).otherwise(key_values(text))
    wanted = F.lit(True) if "*" in sources else F.col("source").isin(sources)
    return df.withColumn("fields", to_bag(merge(bag(), F.when(wanted, found).otherwise(F.create_map().cast(BAG)))))


def apply_declarative_parsers(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Specs: source, guard (regex), extract (list of {regex|kv|json}), map ({target: literal or ``$capture``}).

    Targets are category, severity, src_ip, dst_ip, url, action, and ``fields.<key>``. The first writer of a
    target wins; severity is taken only from 0 to 4.
    """
    taken = [F.col(f"`{c}`") for c in df.columns]
    text, columns = F.substring("message", 1, MAX_MESSAGE), {}
    # each spec's captures become columns of an inner struct, so that later steps read them and don't repeat them
    rows = df.select(F.struct(*taken).alias("row"), text.alias("text"), bag().alias("bag"))
    at = lambda c: F.col("row").getField(c)
    none = F.create_map().cast(BAG)
    for n, spec in enumerate(specs):
        applies = F.lit(True)
        if spec.get("source", "*") != "*":
            applies &= F.coalesce(at("source") == spec["source"], F.lit(False))
        if spec.get("guard"):
            applies &= F.coalesce(F.col("text").rlike(java_pattern(spec["guard"])), F.lit(False))
        found = [captured(F.col("text"), x["regex"]) if "regex" in x else json_values(F.col("text")) if "json" in x else key_values(F.col("text")) for x in spec.get("extract", ())]
        rows = rows.withColumn(f"applies{n}", applies)
        whole = reduce(lambda x, y: let(F.struct(x.alias("x"), y.alias("y")), lambda z: merge(z["x"], z["y"])), found) if found else none
        rows = rows.withColumn(f"found{n}", F.when(F.col(f"applies{n}"), whole).otherwise(none))
        for target, value in spec.get("map", {}).items():
            v = F.col(f"found{n}")[value[1:]] if isinstance(value, str) and value.startswith("$") else F.lit(str(value))
            columns.setdefault(target, []).append(F.when(F.col(f"applies{n}"), v))
    out, extra = {}, []
    for target, values in columns.items():
        v = F.coalesce(*values)
        if target.startswith("fields.") or target == "action":
            extra.append(F.create_map(F.lit(target.removeprefix("fields.")), v))
        elif target == "severity":
            n = v.try_cast("int")
            out[target] = F.coalesce(F.when(n.between(0, 4), n), at("severity") if "severity" in df.columns else F.lit(None))
        else:
            out[target] = F.coalesce(F.nullif(at(target), F.lit("")), v) if target in df.columns else v
    m = F.col("bag")
    for new in [*[F.col(f"found{n}") for n in range(len(specs))], *extra]:
        m = let(F.struct(m.alias("x"), new.alias("y")), lambda z: merge(z["x"], z["y"]))
    out["fields"] = let(m, to_bag)
    names = [*df.columns, *[c for c in out if c not in df.columns]]
    return rows.select(*[out[c].alias(c) if c in out else at(c).alias(c) for c in names])


# Endpoint alerts, where each family's fields stand in the payload.
ENDPOINT_FIELDS = {
    "posture_policy": "$.data.sca.policy", "posture_check": "$.data.sca.check.title", "posture_result": "$.data.sca.check.result", "posture_compliance": "$.data.sca.check.compliance",
    "vuln_id": "$.data.vulnerability.cve", "vuln_severity": "$.data.vulnerability.severity", "vuln_package": "$.data.vulnerability.package.name", "vuln_version": "$.data.vulnerability.package.version",
    "fim_path": "$.syscheck.path", "fim_event": "$.syscheck.event", "fim_hash": "$.syscheck.sha256_after",
    "inventory_name": "$.data.program.name", "inventory_version": "$.data.program.version",
    "rule_id": "$.rule.id", "rule_level": "$.rule.level", "rule_description": "$.rule.description", "agent": "$.agent.name",
}


def normalize_endpoint(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Endpoint alerts (JSON) to category, severity, host, message and field families."""
    p = F.col(payload)
    got = {k: F.get_json_object(p, path) for k, path in ENDPOINT_FIELDS.items()}
    category = F.when(got["posture_result"].isNotNull(), "posture").when(got["vuln_id"].isNotNull(), "vulnerability").when(got["fim_path"].isNotNull(), "integrity").when(got["inventory_name"].isNotNull(), "inventory").otherwise("endpoint")
    named = F.lower(got["vuln_severity"])
    level = got["rule_level"].try_cast("int")
    severity = (
        F.when(got["vuln_id"].isNotNull(), F.when(named == "critical", 4).when(named == "high", 3).when(named == "medium", 2).otherwise(1))
        .when(got["posture_result"].isNotNull(), F.when(F.lower(got["posture_result"]).isin("failed", "fail"), 2).otherwise(0))
        .when(got["fim_path"].isNotNull(), F.when(F.lower(got["fim_event"]) == "deleted", 3).otherwise(2))
        .otherwise(F.when(level >= 12, 4).when(level >= 8, 3).when(level >= 5, 2).when(level >= 3, 1).otherwise(0))
    )
    fields = F.map_filter(F.create_map(*[x for k, v in got.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return df.withColumns({"category": category, "severity": severity, "host": got["agent"], "message": F.coalesce(got["rule_description"], F.lit("")), "fields": to_bag(fields)})


def promote_columns(df: DataFrame) -> DataFrame:
    """src_ip, dst_ip and url from the bag where the column is empty."""
    at = lambda k: F.nullif(F.get_json_object("fields", f"$['{k}']"), F.lit(""))
    own = lambda k: F.nullif(F.col(k), F.lit("")) if k in df.columns else F.lit(None).cast("string")
    return df.withColumns({"src_ip": F.coalesce(own("src_ip"), at("src_ip"), at("rhost")), "dst_ip": F.coalesce(own("dst_ip"), at("dst_ip")), "url": F.coalesce(own("url"), at("url"))})


# Phrases of authentication logs, in the order they decide.
AUTH_USER = [
    r"^\s*([A-Za-z0-9._-]+)\s* : ",
    r" for (?:invalid user )?(.+?) from ",
    r"Invalid user (\S+)",
    r"invalid user (\S+)",
    r"from user (\S+)",
    r"for user ([^\s(]+)",
    r"\(to [^)]*\) (\S+)",
]
AUTH_ACTION = [
    ("success", r"accepted "),
    ("failure", r"failed password|authentication failure|failed publickey|not in sudoers|incorrect password|user not allowed|command not allowed|a password is required|a terminal is required|invalid user"),
    ("sudo", r"command="),
    ("session_open", r"session opened"),
    ("session_close", r"session closed"),
]
AUTH_IP = r" from \[?([0-9A-Fa-f.:]*[.:][0-9A-Fa-f.:]*)(?:\]|/|\s|$)"


def auth_user(message: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(message, p, 1)), F.lit("")) for p in AUTH_USER])


def auth_action(message: Column) -> Column:
    low = F.lower(message)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(a)) for a, p in AUTH_ACTION])


def auth_source_ip(message: Column) -> Column:
    ip = F.regexp_extract(message, AUTH_IP, 1)
    return F.when(F.length(ip) >= 3, ip)


def derive_auth_fields(df: DataFrame) -> DataFrame:
    """user and action in the bag, src_ip, and severity 3 on fail, invalid, error or denied."""
    m = F.col("message")
    new = F.create_map(F.lit("user"), auth_user(m), F.lit("action"), auth_action(m))
    bad = F.lower(m).rlike("fail|invalid|error|denied")
    return df.withColumns({"fields": to_bag(merge(bag(), new)), "src_ip": F.coalesce(F.col("src_ip"), auth_source_ip(m)), "severity": F.when(bad, 3).otherwise(F.coalesce("severity", F.lit(0)))})


def resolve_category(df: DataFrame, vocabulary: list[str] = CATEGORIES, parsed: str | None = None) -> DataFrame:
    """The collector's category wins over a parser's; category_state is canonical, off-vocabulary or absent."""
    c = F.nullif(F.col("category"), F.lit(""))
    if parsed:
        c = F.coalesce(c, F.nullif(F.col(parsed), F.lit("")))
    state = F.when(c.isNull(), "absent").when(c.isin(list(vocabulary)), "canonical").otherwise("off-vocabulary")
    return df.withColumns({"category": c, "category_state": state})


def stamp_version(df: DataFrame, version: str = MODEL_VERSION) -> DataFrame:
    """The model version in the bag, whatever stood there."""
    rest = F.map_filter(bag(), lambda k, v: k != "cim")
    return df.withColumn("fields", to_bag(F.map_concat(rest, F.create_map(F.lit("cim"), F.lit(version)))))


def reserve_source(df: DataFrame) -> DataFrame:
    """Ingested rows can't use the source names kept for the system."""
    s = F.col("source")
    return df.withColumn("source", F.when(s.startswith(RESERVED_SOURCE), F.concat(F.lit("ext:"), s)).otherwise(s))


def ioc_keys(iocs: DataFrame, now: int) -> DataFrame:
    """One row for each live indicator value: key and meta, the most confident first."""
    live = iocs.where(F.col("expires").isNull() | (F.col("expires") == 0) | (F.col("expires") > now))
    meta = F.struct(F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("severity", F.lit(0)).alias("severity"), "source", "type")
    return live.groupBy(F.lower(F.trim("value")).alias("key")).agg(F.max(meta).alias("meta"))


#: 64 KiB: the filter is copied with each row that it is joined to, so its size counts once a row.
FILTER_BITS = 1 << 19


def _bit(key: Column, probe: int, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(bits))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """bits: one row with an array of ``bits`` bits in which two of each key (column ``key``) are set; its size is the same for any number of keys."""
    word, at = zip(*(_bit(F.col("key"), p, bits) for p in range(2)))
    set_ = keys.select(F.explode(F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), a).alias("value")) for w, a in zip(word, at)])).alias("x"))
    words = set_.groupBy("x.word").agg(F.bit_or("x.value").alias("value"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0)).alias("value")))), lambda x: x["value"]).alias("bits"))


def _may_be(key: Column, words: Column, bits: int) -> Column:
    """Is the key perhaps in the filter? Null is not."""
    tests = []
    for p in range(2):
        word, at = _bit(key, p, bits)
        tests.append(F.call_function("shiftright", F.get(words, word), at).bitwiseAND(F.lit(1)) == 1)
    return key.isNotNull() & tests[0] & tests[1]


def with_hits(df: DataFrame, probe: Callable[[Column], Column], keys: DataFrame, find: Callable[[DataFrame], DataFrame], use: Callable[[Column], dict[str, Column]], bits: int = FILTER_BITS) -> DataFrame:
    """Columns from rare matches, without moving the rows that have none.

    ``probe`` makes of the bits of a filter over ``keys`` a value that is null where a row can't match, and else holds all that
    its match depends on. Rows with null pass as they are. The distinct values of the others go to ``find``, which gives back
    ``probe`` and ``hit``, and the answers are joined to their rows by value: nothing hangs on ids or on row numbers, which a
    task that runs again could give otherwise. The filter has a fixed size and is broadcast; ``find`` may use any join.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.crossJoin(F.broadcast(key_filter(keys, bits).withColumnRenamed("bits", "_bits")))  # a single row of bits / 8 bytes
    rows = rows.select(kept, probe(F.col("_bits")).alias("probe"))
    some = rows.where(F.col("probe").isNotNull())
    hits = find(some.select("probe").distinct())
    met = some.join(hits, "probe", "left").select("row", "hit")
    hit = dict(hits.dtypes)["hit"]
    out = rows.where(F.col("probe").isNull()).select("row", F.lit(None).cast(hit).alias("hit")).unionByName(met)
    new = use(F.col("hit"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def match_iocs(df: DataFrame, iocs: DataFrame, now: int) -> DataFrame:
    """Adds ti_match, ti_confidence, ti_severity and threat_intel for the first indicator that hits; no row is dropped.

    Only rows with a candidate that passes a filter of fixed size over the indicators meet them, each distinct list of candidates once.
    """
    own = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("src_ip", "dst_ip", "url")]
    member = (lambda k: F.get_json_object("fields", f"$['{k}']")) if "fields" in df.columns else lambda k: F.lit(None).cast("string")
    tried = F.transform(F.array(*own, *[member(k) for k in IOC_FIELDS]), lambda x, i: F.struct(i.alias("pos"), F.lower(F.trim(x)).alias("key")))
    live = ioc_keys(iocs, now).where("key <> ''")

    def probe(bits: Column) -> Column:
        return let(F.filter(tried, lambda x: _may_be(x["key"], bits, FILTER_BITS)), lambda x: F.when(F.size(x) > 0, x))

    def find(lists: DataFrame) -> DataFrame:
        met = lists.select("probe", F.explode("probe").alias("x")).select("probe", "x.pos", "x.key").join(live, "key")
        return met.groupBy("probe").agg(F.min(F.struct("pos", "key", "meta")).alias("hit"))

    def use(hit: Column) -> dict[str, Column]:
        return {"ti_match": hit["key"], "ti_confidence": hit["meta"]["confidence"], "ti_severity": hit["meta"]["severity"], "threat_intel": hit.isNotNull()}

    return with_hits(df, probe, live, find, use)


def _octets(ip: Column, n: int) -> Column:
    """The first ``n`` octets with their dots; null if there are fewer dots."""
    return F.when(F.size(F.split(ip, r"\.", -1)) > n, F.concat(F.substring_index(ip, ".", n), F.lit(".")))


def tag_scope(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """engagement_id of the smallest scope whose matcher (an address, or its beginning) and window hold the event.

    A scope stands under keys that an event can look up: its whole octets (none: a key of all addresses) and the days of its window, or
    one key for all days where it is long. Events whose keys pass a filter of fixed size meet the scopes of the same key, each
    distinct (address, time) once; the exact test comes after. A null address or time is in no scope.
    """
    ip, ts, day = F.col("src_ip").cast("string"), F.col("ts"), 86400
    matcher = F.col("matcher")
    stem = F.when(~F.col("is_prefix"), F.concat(F.lit("="), matcher)).when(matcher.contains("."), F.regexp_extract(matcher, r"^((?:[^.]*\.){1,3})", 1)).otherwise("")
    lo, hi = F.floor(F.col("window_start") / day), F.floor(F.col("window_end") / day)
    days = F.when((hi >= lo) & (hi - lo < SCOPE_DAYS), F.sequence(lo, hi).cast("array<string>")).when(hi >= lo, F.array(F.lit("*")))
    keyed = scopes.select("id", "matcher", "is_prefix", "window_start", "window_end", stem.alias("stem"), F.explode(days).alias("day"))
    keyed = keyed.select(F.concat_ws("|", "stem", "day").alias("key"), "id", "matcher", "is_prefix", "window_start", "window_end")

    def keys(ip: Column, ts: Column) -> Column:
        stems = F.array(F.concat(F.lit("="), ip), F.lit(""), *[_octets(ip, n) for n in (1, 2, 3)])
        own = F.transform(F.filter(stems, lambda x: x.isNotNull()), lambda x: F.array(F.concat(x, F.lit("|*")), F.concat(x, F.lit("|"), F.floor(ts / day).cast("string"))))
        return F.flatten(own)

    def probe(bits: Column) -> Column:
        return F.when(ip.isNotNull() & ts.isNotNull() & F.exists(keys(ip, ts), lambda k: _may_be(k, bits, FILTER_BITS)), F.struct(ip.alias("ip"), ts.alias("ts")))

    def find(values: DataFrame) -> DataFrame:
        looked = values.select("probe", F.explode(keys(F.col("probe.ip"), F.col("probe.ts"))).alias("key")).join(keyed, "key")
        inside = F.when(F.col("is_prefix"), F.col("probe.ip").startswith(F.col("matcher"))).otherwise(F.col("probe.ip") == F.col("matcher"))
        return looked.where(inside & F.col("probe.ts").between(F.col("window_start"), F.col("window_end"))).groupBy("probe").agg(F.min("id").alias("hit"))

    rows = df if "engagement_id" in df.columns else df.withColumn("engagement_id", F.lit(None).cast("string"))
    before = unused(rows, "_before")
    out = with_hits(rows.withColumnRenamed("engagement_id", before), probe, keyed.select("key").distinct(), find, lambda hit: {"engagement_id": hit})
    return out.withColumn("engagement_id", F.coalesce("engagement_id", before)).drop(before)


def _rule_test(rule: dict, columns: list[str]) -> Column:
    name, op, value = rule["field"], rule["op"], rule.get("value", "")
    c = F.col(name).cast("string") if name in columns else F.get_json_object("fields", f"$['{name}']")
    test = {"eq": lambda: c == value, "ne": lambda: c != value, "contains": lambda: c.contains(value), "regex": lambda: c.rlike(java_pattern(value)), "any": lambda: c.isNotNull()}[op]()
    return F.coalesce(test, F.lit(False))


def apply_processors(df: DataFrame, rules: list[dict], id_col: str = "id") -> DataFrame:
    """Ordered rules (field, op, value, action, arg): drop, mask, route, sample. Absent fields never match.

    Sampling keeps one row in ``arg`` by a hash of the id, which a stream can do as well.
    """
    out = df if "env_id" in df.columns else df.withColumn("env_id", F.lit(DEFAULT_ENV))
    for rule in rules:
        hit = _rule_test(rule, out.columns)
        if rule["action"] == "drop":
            out = out.where(~hit)
        elif rule["action"] == "sample":
            out = out.where(~hit | (F.pmod(F.xxhash64(F.col(id_col)), F.lit(int(rule["arg"]))) == 0))
        elif rule["action"] == "route":
            out = out.withColumn("env_id", F.when(hit, rule["arg"]).otherwise(F.col("env_id")))
        else:
            target = rule.get("arg") or rule["field"]
            if target in out.columns:
                out = out.withColumn(target, F.when(hit & F.col(target).isNotNull(), "[redacted]").otherwise(F.col(target)))
            else:
                masked = F.transform_values(bag(), lambda k, v: F.when(k == target, "[redacted]").otherwise(v))
                out = out.withColumn("fields", F.when(hit, to_bag(masked)).otherwise(F.col("fields")))
    return out


def processor_counts(df: DataFrame, rules: list[dict]) -> DataFrame:
    """rule, matched: rows that each rule matches on its own; one pass."""
    counts = df.agg(*[F.count_if(_rule_test(r, df.columns)).alias(str(r.get("id", i))) for i, r in enumerate(rules)])
    return counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("rule", "matched"))


def sample_every_n(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First of every n rows of each key, by ts and id.

    Rows are numbered inside each hour and the rows of earlier hours added, so that a busy key, or no key at
    all, never puts all rows into one task.
    """
    columns = [F.col(f"`{c}`").alias(c) for c in df.columns]
    rows = df.select(F.struct(*columns).alias("row"), F.struct(*keys, F.floor(F.col("ts") / 3600).alias("_hour")).alias("at"), "ts", "id")
    key, hour = [F.col("at").getField(k) for k in keys], F.col("at._hour")
    before = Window.partitionBy(*key).orderBy(hour).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("at").agg(F.count("*").alias("held"))
    offsets = counts.select(F.col("at").alias("of"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("at").orderBy("ts", "id"))
    out = rows.withColumn("number", number).join(offsets, F.col("at") == F.col("of"))  # a struct is never null, so null keys meet
    return out.where((F.col("number") + F.col("before")) % n == (1 % n)).select("row.*")


def dedup_events(df: DataFrame) -> DataFrame:
    """First row by ts, id of each (host, dedup); rows without a dedup key all stay."""
    w = Window.partitionBy("host", "dedup").orderBy("ts", "id")
    n = unused(df, "_n")
    keyed = df.where(F.col("dedup").isNotNull()).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
    return df.where(F.col("dedup").isNull()).unionByName(keyed)


def capture_snapshots(df: DataFrame) -> DataFrame:
    """Runs of equal state per (kind, host): the first row of each with last_seen and the number of captures."""
    w = Window.partitionBy("kind", "host").orderBy("ts", "id")
    new = F.coalesce(F.lag("hash").over(w) != F.col("hash"), F.lit(True))
    runs = df.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("kind", "host", "_run").agg(F.min("ts").alias("ts"), F.max("ts").alias("last_seen"), F.min("hash").alias("hash"), F.count("*").alias("captures")).drop("_run")


def latest_snapshot_per_host(df: DataFrame, kind: str) -> DataFrame:
    rest = [c for c in df.columns if c != "host"]
    return df.where(F.col("kind") == kind).groupBy("host").agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("_x")).select("host", *[F.col(f"_x.{c}") for c in rest])


def diff_baseline(current: DataFrame, baseline: DataFrame, keys: list[str], value: str = "hash") -> DataFrame:
    """keys, change (added, removed or modified), old and new value."""
    a = baseline.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = current.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_b"))
    j = a.join(b, keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change", "old", "new")


def reparse(df: DataFrame, parsers: list[tuple[str, str]], since: int) -> DataFrame:
    """Parsers once more over rows from ``since`` on; only missing fields are filled. Rows without a time stay as they are."""
    late = F.coalesce(F.col("ts") >= since, F.lit(False))
    return df.where(~late).unionByName(apply_regex_parsers(df.where(late), parsers))


def relabel_corroborated(df: DataFrame, deploys: DataFrame, window: int = 3600, lowered: int = 1) -> DataFrame:
    """Lower, never raise, the severity of integrity events that a deployment explains (name, hash, deployed_at).

    Only integrity events whose name and hash pass a filter of fixed size over the deployments meet them; all others pass as they are.
    """
    name, sha = F.substring_index(F.get_json_object("fields", "$['path']"), "/", -1), F.get_json_object("fields", "$['hash']")
    ts = F.col("ts")
    known = deploys.where("name is not null and hash is not null").groupBy("name", "hash").agg(F.collect_set("deployed_at").alias("times"))
    text = lambda a, b: F.concat_ws("|", F.length(a).cast("string"), a, b)
    may = (F.col("category") == "integrity") & (F.col("severity") > lowered) & ts.isNotNull() & name.isNotNull() & sha.isNotNull()

    def probe(bits: Column) -> Column:
        return F.when(may, F.when(_may_be(text(name, sha), bits, FILTER_BITS), F.struct(name.alias("name"), sha.alias("hash"), ts.alias("ts"))))

    def find(values: DataFrame) -> DataFrame:
        met = values.select("probe", "probe.name", "probe.hash").join(known, ["name", "hash"])
        return met.where(F.exists("times", lambda t: (F.col("probe.ts") >= t) & (F.col("probe.ts") <= t + window))).select("probe", F.lit(True).alias("hit"))

    def use(hit: Column) -> dict[str, Column]:
        row = lambda c: F.col("row").getField(c)
        marked = merge(F.create_map(F.lit("severity_original"), row("severity").cast("string")), json_map(row("fields")))
        return {"fields": F.when(hit, to_bag(marked)).otherwise(row("fields")), "severity": F.when(hit, F.lit(lowered)).otherwise(row("severity"))}

    out = with_hits(df, probe, known.select(text(F.col("name"), F.col("hash")).alias("key")), find, use)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def required_text(pattern: str) -> tuple[str, bool] | None:
    """(a text of three characters or more that every match holds, whether its case is free); None if there is none for sure.

    The pattern is read by Python's own parser; what that doesn't know (or Java reads otherwise) has no text.
    """
    try:
        tree = parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    runs, free = [""], bool(tree.state.flags & re.IGNORECASE)

    def walk(items) -> bool:
        """False where a group changes flags, which ends the search."""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN":
                if arg[1] or arg[2] or not walk(arg[3]):
                    return False
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                runs.append("")
                if not walk(arg[2]):
                    return False
                runs.append("")
            else:
                runs.append("")
        return True

    if not walk(tree):
        return None
    best = max(runs, key=len)
    return (best, free) if len(best) >= 3 and (best.isascii() or not free) else None


def scan_patterns(df: DataFrame, patterns: dict[str, str], columns: list[str], id_col: str = "id") -> DataFrame:
    """id, column, pattern for every named pattern found in every text column; one pass over the rows.

    A pattern is tried only on texts that hold the text which each of its matches needs; the lower-cased text is made once a column.
    """
    low = {c: unused(df, f"_low_{i}") for i, c in enumerate(columns)}
    rows = df.withColumns({low[c]: F.lower(F.col(c)) for c in columns})

    def found(c: str, p: str) -> Column:
        java, need = java_pattern(p), required_text(p)
        hit = F.col(c).rlike(java)
        if need is None:
            return hit
        text, free = need
        return F.when(F.col(low[c]).contains(text.lower()) if free else F.col(c).contains(text), hit)

    tests = [F.when(F.coalesce(found(c, p), F.lit(False)), F.struct(F.lit(c).alias("column"), F.lit(k).alias("pattern"))) for c in columns for k, p in patterns.items()]
    hits = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return rows.select(id_col, F.explode(hits).alias("x")).select(id_col, "x.column", "x.pattern")


URL = r"""(?i)\bhttps?://[^\s<>"'\\)\]}]+"""
HREF = r"""(?i)(?:href|src)\s*=\s*["']([^"'\s>]+)["']"""


def extract_urls(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """id, url, origin (text, html or decoded): URLs in text, in attributes, and in base64 query values."""
    text = F.col(column)
    plain = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.struct(u.alias("url"), F.lit("text").alias("origin")))
    linked = F.transform(F.regexp_extract_all(text, F.lit(HREF), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit("html").alias("origin")))
    values = F.regexp_extract_all(text, F.lit(r"[?&][\w-]+=(aHR0c[A-Za-z0-9+/_-]+)"), F.lit(1))  # base64 of "http"

    def decoded(v: Column) -> Column:
        body = F.translate(v, "-_", "+/")
        fill = F.repeat(F.lit("="), ((4 - F.length(body) % 4) % 4).cast("int"))
        return F.struct(F.try_to_binary(F.concat(body, fill), F.lit("base64")).cast("string").alias("url"), F.lit("decoded").alias("origin"))

    every = F.array_distinct(F.concat(plain, linked, F.transform(values, decoded)))
    return df.select(id_col, F.explode(every).alias("x")).select(id_col, "x.url", "x.origin").where("url is not null")
