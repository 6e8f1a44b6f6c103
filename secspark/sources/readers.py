"""Readers of landed payloads, in batch; the same decoders take a streaming frame of text lines.

Each ``decode_*`` function turns a DataFrame of raw text (column ``value``) into event rows; each ``read_*``
function reads files first. JSON that can't be read never fails a job: it is dropped, or counted where
``bad_records`` says so.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.functions.scalar import epoch, iso_epoch

from secspark.operators.normalize import BAG, auth_action, auth_source_ip, auth_user, json_map, json_members, key_values, let, merge, to_bag, unique
from secspark.vocabulary import PRESETS, SOURCETYPE_CATEGORY

EVENT_COLUMNS = ["ts", "source", "category", "severity", "host", "message", "src_ip", "dst_ip", "url", "dedup", "fields"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def j(c: Column | str, path: str) -> Column:
    """A JSON member as text, null if absent or empty."""
    return F.nullif(F.get_json_object(c, path), F.lit(""))


def items(c: Column, path: str = "$") -> Column:
    """Elements of a JSON array, or a single object as one element, as JSON texts."""
    text = F.get_json_object(c, path)
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")), F.when(text.isNotNull(), F.array(text)))


def events(df: DataFrame, **columns: Column) -> DataFrame:
    """Event rows; columns that aren't given are null."""
    return df.select(*[columns.get(c, F.lit(None).cast({"ts": "long", "severity": "int"}.get(c, "string"))).alias(c) for c in EVENT_COLUMNS])


# S1
def decode_envelopes(df: DataFrame) -> DataFrame:
    """``{ts, host, kind, events: [...]}``; an event's own ts and host come first."""
    rows = df.select("value", F.explode(items(F.col("value"), "$.events")).alias("e"))
    v, e = F.col("value"), F.col("e")
    return events(
        rows, ts=F.coalesce(epoch(j(e, "$.ts")), epoch(j(v, "$.ts"))), host=F.coalesce(j(e, "$.host"), j(v, "$.host")), source=F.coalesce(j(e, "$.source"), F.lit("agent")), category=j(e, "$.category"),
        severity=F.coalesce(j(e, "$.severity").try_cast("int"), F.lit(0)), message=F.coalesce(j(e, "$.message"), F.lit("")), src_ip=j(e, "$.src_ip"), dst_ip=j(e, "$.dst_ip"), url=j(e, "$.url"), dedup=j(e, "$.dedup"), fields=j(e, "$.fields"),
    )


def read_event_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return decode_envelopes(whole_files(spark, path))


# S2
def decode_journald(df: DataFrame) -> DataFrame:
    """One JSON object a line; severity from the text, else from PRIORITY."""
    v = F.col("value")
    m, low = F.coalesce(j(v, "$.MESSAGE"), F.lit("")), F.lower(F.coalesce(j(v, "$.MESSAGE"), F.lit("")))
    priority = F.coalesce(j(v, "$.PRIORITY").try_cast("int"), F.lit(6))
    severity = F.when(low.rlike("fail|invalid|error|denied") | (priority <= 3), 3).when(priority == 4, 2).otherwise(0)
    bag = F.map_filter(F.create_map(F.lit("pid"), j(v, "$._PID"), F.lit("uid"), j(v, "$._UID"), F.lit("unit"), j(v, "$._SYSTEMD_UNIT"), F.lit("user"), auth_user(m), F.lit("action"), auth_action(m)), lambda k, x: x.isNotNull())
    ok = df.where(F.coalesce(F.from_json("value", BAG).isNotNull(), F.lit(False)))
    return events(ok, ts=F.floor(j(v, "$.__REALTIME_TIMESTAMP").try_cast("long") / 1_000_000), source=F.coalesce(j(v, "$._COMM"), F.lit("journal")), category=F.lit("auth"), severity=severity, host=j(v, "$._HOSTNAME"), message=m, src_ip=auth_source_ip(m), dedup=j(v, "$.__CURSOR"), fields=to_bag(bag))


def read_journald(spark: SparkSession, path: str) -> DataFrame:
    return decode_journald(lines(spark, path))


# S3
def _split_json(batches):
    """Objects of concatenated JSON, one after another; a broken stretch is skipped to the next brace."""
    import json
    import re

    import pyarrow as pa

    decode, gap = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n,]*")
    for batch in batches:
        good, bad = [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            at = gap.match(text).end()
            while at < len(text):
                try:
                    value, end = decode(text, at)
                    for x in value if isinstance(value, list) else [value]:
                        (good if isinstance(x, dict) else bad).append(json.dumps(x))
                except ValueError:
                    end = text.find("{", at + 1)
                    end = len(text) if end < 0 else end
                    bad.append(text[at:end])
                at = gap.match(text, end).end()
        yield pa.RecordBatch.from_arrays([pa.array(good + bad, pa.string()), pa.array([True] * len(good) + [False] * len(bad), pa.bool_())], ["value", "ok"])


def split_json(df: DataFrame) -> DataFrame:
    """value (one object), ok (False: a fragment that can't be read)."""
    return df.select("value").mapInArrow(_split_json, "value string, ok boolean")


def decode_hec(df: DataFrame) -> DataFrame:
    """Collector records, one JSON object in ``value`` each. Records with neither event nor fields are left out."""
    # a generator's output is computed once, however often it is used and filtered by
    rows = df.select(F.explode(F.array(json_members(F.col("value")))).alias("v"))
    v = lambda k: F.nullif(F.col("v")[k], F.lit(""))
    event, own = v("event"), F.col("own")
    usable = rows.select("v", F.explode(F.array(json_map(v("fields")))).alias("own")).where(event.isNotNull() | (F.size(own) > 0))
    inner = json_map(F.when(F.ltrim(event).startswith("{"), event))
    bag = merge(merge(own, inner), F.create_map(F.lit("sourcetype"), v("sourcetype"), F.lit("index"), v("index")))
    table = F.create_map(*[F.lit(x) for kv in SOURCETYPE_CATEGORY.items() for x in kv])
    return events(usable, ts=epoch(v("time")), source=F.coalesce(v("source"), F.lit("hec")), category=F.get(F.array(table[F.lower(v("sourcetype"))]), 0), severity=F.lit(0), host=v("host"), message=F.coalesce(event, F.lit("")), fields=to_bag(bag))


def is_one_object(text: Column) -> Column:
    """Is a text exactly one JSON object, with nothing before or after it?"""
    wrapped = F.concat(F.lit('{"w":['), text, F.lit('],"end":1}'))
    return F.coalesce(F.ltrim(text).startswith("{") & (F.get_json_object(wrapped, "$.end") == "1") & (F.json_array_length(F.get_json_object(wrapped, "$.w")) == 1), F.lit(False))


def read_hec(spark: SparkSession, path: str) -> DataFrame:
    """Single, concatenated, line-wise or array records; fragments that can't be read are skipped.

    Files with one object a line are read line by line, split over tasks, without Python. Only files that hold anything else go
    through the splitter, each as one value; their names are gathered when the reader is called.
    """
    each = spark.read.text(path).select("value", F.expr("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    odd = each.where(~is_one_object(F.col("value"))).select("file").distinct()
    names = [r["file"] for r in odd.collect()]
    plain = each.join(odd, "file", "left_anti").select("value") if names else each.select("value")
    if names:
        plain = plain.unionByName(split_json(spark.read.text([unquote(n) for n in names], wholetext=True)).where("ok").select("value"))
    return decode_hec(plain)


def bad_records(df: DataFrame) -> DataFrame:
    """Number of fragments of collector payloads that can't be read."""
    return split_json(df).agg(F.count_if(~F.col("ok")).alias("bad"))


# S4
_ATTR = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_SPANS = f"resourceSpans array<struct<resource:struct<attributes:{_ATTR}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTR}>>>>>>"
# Span kinds and status codes.
SPAN_KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]


def _attributes(c: Column) -> Column:
    entries = F.transform(F.coalesce(c, F.array().cast(_ATTR)), lambda a: F.named_struct(F.lit("key"), F.concat(F.lit("otel."), a["key"]), F.lit("value"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"))))
    first = F.filter(entries, lambda x, i: (F.array_position(F.transform(entries, lambda y: y["key"]), x["key"]) == i + 1) & x["value"].isNotNull())
    return F.map_from_entries(first)


def decode_otlp_traces(df: DataFrame) -> DataFrame:
    rows = df.select(F.explode(F.from_json("value", _SPANS)["resourceSpans"]).alias("r"))
    rows = rows.select(_attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeSpans").alias("s"))
    rows = rows.select("ra", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x")).where("x.traceId <> '' and x.spanId <> ''")
    x = lambda k: F.col(f"x.{k}")
    trace, span, service = F.lower(x("traceId")), F.lower(x("spanId")), F.nullif(F.col("ra")["otel.service.name"], F.lit(""))
    code = F.upper(F.coalesce(x("status.code"), F.lit("0")))
    status = F.when(code.isin("2", "STATUS_CODE_ERROR"), "error").when(code.isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset")
    start, end = x("startTimeUnixNano").try_cast("decimal(20,0)"), x("endTimeUnixNano").try_cast("decimal(20,0)")
    kind = F.coalesce(F.get(F.array(*[F.lit(k) for k in SPAN_KINDS]), x("kind").try_cast("int")), F.lower(F.regexp_replace(x("kind"), "^SPAN_KIND_", "")), F.lit("unspecified"))
    made = F.create_map(*[
        y for k, c in {
            "trace_id": trace, "span_id": span, "parent_span_id": F.lower(F.nullif(x("parentSpanId"), F.lit(""))), "span_name": F.nullif(x("name"), F.lit("")), "span_kind": kind, "trace_status": status,
            "status_message": x("status.message"), "service": service, "scope_name": F.col("scope.name"), "scope_version": F.col("scope.version"), "duration_ms": (F.greatest(end - start, F.lit(0)).cast("double") / 1e6).cast("string"),
        }.items() for y in (F.lit(k), c)
    ])
    bag = merge(merge(F.map_filter(made, lambda k, v: v.isNotNull()), _attributes(x("attributes"))), F.col("ra"))
    host = F.coalesce(*[F.col("ra")[k] for k in ("otel.host.name", "otel.k8s.node.name", "otel.host.id", "otel.container.name")])
    return events(rows, ts=F.when(start > 0, F.floor(start / 1_000_000_000).cast("long")), source=F.coalesce(service, F.lit("otlp")), category=F.lit("trace"), severity=F.when(status == "error", 3).otherwise(0), host=host, message=F.coalesce(x("name"), F.lit("")), dedup=F.concat_ws("-", F.lit("otel"), trace, span), fields=to_bag(bag))


def read_otlp_traces(spark: SparkSession, path: str) -> DataFrame:
    return decode_otlp_traces(whole_files(spark, path))


# S5. Label aliases, the first that is present counts; severity by level.
LABEL_SOURCE = ["job", "service_name", "service", "unit", "container", "app", "filename"]
LABEL_HOST = ["host", "hostname", "instance", "node", "nodename"]
LABEL_LEVEL = ["level", "severity", "detected_level"]
LEVEL_SEVERITY = {"critical": 4, "fatal": 4, "emerg": 4, "alert": 4, "error": 3, "err": 3, "warn": 2, "warning": 2, "notice": 1, "info": 0, "debug": 0, "trace": 0}


def decode_loki(df: DataFrame) -> DataFrame:
    rows = df.select(F.explode(F.from_json("value", "streams array<struct<stream:map<string,string>,values:array<array<string>>>>")["streams"]).alias("s"))
    rows = rows.select(unique(F.col("s.stream")).alias("l"), F.explode("s.values").alias("v"))
    pick = lambda names: F.coalesce(*[F.nullif(F.col("l")[n], F.lit("")) for n in names])
    levels = F.create_map(*[F.lit(x) for kv in LEVEL_SEVERITY.items() for x in kv])
    return events(rows, ts=F.floor(F.get("v", 0).try_cast("decimal(20,0)") / 1_000_000_000).cast("long"), source=F.coalesce(pick(LABEL_SOURCE), F.lit("loki")), severity=F.coalesce(levels[F.lower(pick(LABEL_LEVEL))], F.lit(0)), host=pick(LABEL_HOST), message=F.coalesce(F.get("v", 1), F.lit("")), fields=to_bag(F.col("l")))


def read_loki_push(spark: SparkSession, path: str) -> DataFrame:
    return decode_loki(whole_files(spark, path))


# S6
SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"


def decode_exposition(df: DataFrame, now: int) -> DataFrame:
    """Metric rows from exposition text, a line each; comments, bad names and values that aren't finite are skipped."""
    v = F.trim("value")
    rows = df.where(~v.startswith("#") & v.rlike(SAMPLE))
    value = F.regexp_extract(v, SAMPLE, 3).try_cast("double")
    label = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
    body = F.regexp_extract(v, SAMPLE, 2)
    keys = F.regexp_extract_all(body, F.lit(label), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(label), F.lit(2)), lambda x: F.regexp_replace(x, r'\\(["\\])', "$1"))
    # of a repeated label the first one stays
    first = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    pairs = F.map_from_entries(first)
    ms = F.regexp_extract(v, SAMPLE, 4).try_cast("long")
    out = rows.select(F.coalesce(F.floor(ms / 1000), F.lit(now)).alias("ts"), F.regexp_extract(v, SAMPLE, 1).alias("name"), F.to_json(pairs).alias("labels"), value.alias("value"))
    return out.where("value is not null and not isnan(value) and abs(value) < double('Infinity')")


def read_prom_exposition(spark: SparkSession, path: str, now: int) -> DataFrame:
    return decode_exposition(lines(spark, path), now)


# S7, S8
def decode_firehose(df: DataFrame) -> DataFrame:
    """``records[].data`` in base64: JSON, JSON lines or enveloped ``logEvents``; one object in ``value`` each."""
    data = F.explode(F.from_json("value", "records array<struct<data:string>>")["records"])
    text = df.select(data.alias("r")).select(F.try_to_binary("r.data", F.lit("base64")).cast("string").alias("value")).where("value is not null")
    objects = split_json(text).where("ok").select("value")
    inner = F.coalesce(items(F.col("value"), "$.logEvents"), items(F.col("value"), "$.events"), F.array("value"))
    return objects.select(F.explode(inner).alias("value"))


def read_firehose(spark: SparkSession, path: str) -> DataFrame:
    return decode_firehose(whole_files(spark, path))


def decode_pubsub(df: DataFrame) -> DataFrame:
    """value (decoded message, one object), poison (True: base64 or JSON that can't be read)."""
    text = F.try_to_binary(j("value", "$.message.data"), F.lit("base64")).cast("string")
    return df.select(text.alias("value"), F.coalesce(F.from_json(text, BAG).isNull(), F.lit(True)).alias("poison"))


def read_pubsub(spark: SparkSession, path: str) -> DataFrame:
    return decode_pubsub(lines(spark, path)).where("not poison").select("value")


# S9. Calls of the object store by weight, and calls that are noise.
DELETE_CALLS = ["DeleteObject", "DeleteObjects", "DeleteMultipleObjects", "DeleteObjectVersion", "DeleteObjectTagging", "DeleteBucket", "DeleteBucketTagging"]
WRITE_CALLS = ["PutObject", "CopyObject", "CompleteMultipartUpload", "NewMultipartUpload", "PutObjectTagging", "PutObjectRetention", "PutObjectLegalHold", "PostPolicyBucket"]
NOISE_CALLS = ["ListObjects", "ListObjectsV2", "ListObjectVersions", "ListBuckets", "ListMultipartUploads", "HeadObject", "HeadBucket", "GetBucketLocation", "GetBucketObjectLockConfig", "GetBucketVersioning", "GetBucketPolicy", "GetBucketTagging", "GetBucketLifecycle", "GetBucketReplication", "GetBucketEncryption", "GetBucketNotification", "GetBucketCors", "GetObjectTagging", "StatObject"]


def decode_object_audit(df: DataFrame, buckets: list[str] = (), drop_apis: list[str] = NOISE_CALLS) -> DataFrame:
    """Audit records (an object, an array, or lines): scope by bucket, noise left out, severity by call."""
    rows = df.select(F.explode(items(F.col("value"))).alias("r"))
    r = F.col("r")
    api, bucket, name = F.coalesce(j(r, "$.api.name"), F.lit("")), j(r, "$.api.bucket"), F.coalesce(j(r, "$.api.object"), F.lit(""))
    rows = rows.where(bucket.isNotNull() & ~api.isin(list(drop_apis)))
    if buckets:
        rows = rows.where(bucket.isin(list(buckets)))
    gone = j(r, "$.requestQuery.versionId").isNotNull() & api.isin(DELETE_CALLS)
    severity = F.when(api.isin(DELETE_CALLS), 4).when(api == "GetObject", 3).when(api.isin(WRITE_CALLS), 2).otherwise(1)
    src = F.nullif(F.regexp_replace(j(r, "$.remotehost"), r"^\[+|\]+$", ""), F.lit(""))
    request = j(r, "$.requestID")
    bag = F.create_map(*[x for k, c in {"bucket": bucket, "object": name, "api": api, "accessKey": j(r, "$.accessKey"), "src_ip": src, "status": j(r, "$.api.status"), "statusCode": j(r, "$.api.statusCode"), "request_id": request, "user_agent": j(r, "$.userAgent"), "version_delete": F.when(gone, "1")}.items() for x in (F.lit(k), c)])
    told = lambda c: F.coalesce(c, F.lit(""))
    message = F.concat(
        F.lit("minio-audit "), api, F.lit(" "), bucket, F.lit("/"), name, F.lit(" status="), told(j(r, "$.api.status")), F.lit(" code="), told(j(r, "$.api.statusCode")), F.lit(" ak="), told(j(r, "$.accessKey")),
        F.lit(" src="), told(src), F.lit(" req="), told(request), F.when(gone, " VERSION-DELETE").otherwise(""),
    )
    dedup = F.concat(F.lit("minioaudit-"), F.coalesce(request, F.concat_ws("-", api, bucket, name)))
    return events(rows, ts=iso_epoch(j(r, "$.time")), source=F.lit("minio-audit"), category=F.lit("data"), severity=severity, message=message, src_ip=src, dedup=dedup, fields=to_bag(F.map_filter(bag, lambda k, v: v.isNotNull())))


def read_object_audit(spark: SparkSession, path: str, buckets: list[str] = (), drop_apis: list[str] = NOISE_CALLS) -> DataFrame:
    return decode_object_audit(lines(spark, path), buckets, drop_apis)


# S10
def map_records(df: DataFrame, field_map: dict[str, str], records_path: str = "$") -> DataFrame:
    """Any JSON to events. ``field_map``: target -> path (``$.a.b`` or ``a.b``) or ``=constant``; ``fields.<key>`` goes into the bag.

    Without a dedup target (or an id, which stands for it) the key is a hash of the record. Severity is a number
    from 0 to 4 or a level by name.
    """
    place = lambda p: p if p.startswith("$") else f"$.{p}"
    rows = df.select(F.explode(items(F.col("value"), place(records_path.replace("[*]", "")) if records_path else "$")).alias("r"))
    value = lambda p: F.lit(p[1:]) if p.startswith("=") else j("r", place(p))
    if "id" in field_map and "dedup" not in field_map:
        field_map = {**field_map, "dedup": field_map["id"]}
    got = {k: value(p) for k, p in field_map.items()}
    bag = F.create_map(*[x for k, c in got.items() if k.startswith("fields.") for x in (F.lit(k[7:]), c)]).cast(BAG) if any(k.startswith("fields.") for k in got) else F.create_map().cast(BAG)
    text = got.get("ts")
    ts = F.coalesce(epoch(text), iso_epoch(text)) if text is not None else F.lit(None).cast("long")
    n = got["severity"].try_cast("int") if "severity" in got else F.lit(0)
    named = F.create_map(*[F.lit(x) for kv in LEVEL_SEVERITY.items() for x in kv])[F.lower(got["severity"])] if "severity" in got else F.lit(None).cast("int")
    severity = F.when(n.between(0, 4), n).otherwise(F.coalesce(named, F.lit(0)))
    dedup = F.coalesce(got["dedup"], F.sha2("r", 256)) if "dedup" in got else F.sha2("r", 256)
    plain = {k: c for k, c in got.items() if k in EVENT_COLUMNS and k not in ("ts", "severity", "dedup", "fields")}
    return events(rows, **plain, ts=ts, severity=severity, dedup=dedup, fields=to_bag(F.map_filter(bag, lambda k, v: v.isNotNull())))


def map_preset(df: DataFrame, name: str) -> DataFrame:
    """:func:`map_records` by a connector preset; the category follows from the record's source type."""
    preset = PRESETS[name]
    kind = preset["fields"].get("sourcetype", "=")[1:]
    constants = {"source": "=" + preset["source"]} | ({"category": "=" + preset["categories"][kind]} if kind in preset["categories"] else {})
    return map_records(df, preset["fields"] | constants, preset["records"])


# S11
STIX_VALUE = r"\[\s*([\w-]+):([\w.'-]+)\s*=\s*'([^']*)'\s*\]"
STIX_TYPES = {"ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "domain", "url": "url", "email-addr": "email", "file": "hash"}


def decode_stix(df: DataFrame, source: str = "stix") -> DataFrame:
    """Indicator rows; ``skipped`` says why an object gives none."""
    rows = df.select(F.explode(items(F.col("value"), "$.objects")).alias("o")).where(j("o", "$.type") == "indicator")
    p = j("o", "$.pattern")
    kind = F.create_map(*[F.lit(x) for kv in STIX_TYPES.items() for x in kv])[F.regexp_extract(p, STIX_VALUE, 1)]
    confidence = F.coalesce(j("o", "$.confidence").try_cast("int"), F.lit(50))
    skipped = F.when(p.isNull(), "no pattern").when(~p.rlike(f"^{STIX_VALUE}$") | kind.isNull(), "unsupported pattern")
    return rows.select(
        kind.alias("type"), F.nullif(F.regexp_extract(p, STIX_VALUE, 3), F.lit("")).alias("value"), F.lit(source).alias("source"), confidence.alias("confidence"), F.when(confidence >= 80, 3).otherwise(2).alias("severity"),
        iso_epoch(j("o", "$.created")).alias("first_seen"), iso_epoch(j("o", "$.modified")).alias("last_seen"), iso_epoch(j("o", "$.valid_until")).alias("expires"), j("o", "$.id").alias("stix_id"), skipped.alias("skipped"),
    )


def read_stix_bundle(spark: SparkSession, path: str) -> DataFrame:
    return decode_stix(whole_files(spark, path)).where("skipped is null").drop("skipped")


# S12. Severity by syslog level 0 to 7.
SYSLOG_SEVERITY = [4, 4, 4, 3, 2, 1, 0, 0]
RFC5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(.*)$"
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?:? ?(.*)$"


def parse_syslog(df: DataFrame, year: int = 2024, column: str = "value") -> DataFrame:
    """Both header forms; structured data into the bag; a line with neither keeps its text."""
    v = F.col(column)
    # each pattern runs once over a line and puts its groups apart by line feeds, which no group but the last can hold; a line that it doesn't match keeps its "<"
    headed = v.startswith("<")
    first = F.when(headed, F.regexp_replace(v, RFC5424, "\n$1\n$2\n$3\n$4\n$5\n$6\n$8\n$7"))
    second = F.regexp_replace(v, RFC3164, "\n$1\n$2\n$3\n$4\n$5\n\n$6\n")
    form = lambda new, x: F.struct(F.lit(new).alias("new"), x.alias("groups"))
    found = let(first, lambda x: F.when(x.startswith("\n"), form(True, x)).when(headed, form(False, second)))
    # a generator's output is computed once, however often it is used
    rows = df.select(v.alias("v"), F.explode(F.array(found)).alias("f"))
    rows = rows.select("v", F.coalesce("f.new", F.lit(False)).alias("new"), F.explode(F.array(F.split(F.when(F.col("f.groups").startswith("\n"), F.col("f.groups")), "\n", 9))).alias("g"))
    v, new, g = F.col("v"), F.col("new"), lambda i: F.nullif(F.get("g", i), F.lit(""))
    part = lambda i: F.when(new, F.nullif(g(i), F.lit("-"))).otherwise(g(i))
    priority = part(1).try_cast("int")
    severity = F.coalesce(F.get(F.array(*[F.lit(s) for s in SYSLOG_SEVERITY]), priority % 8), F.lit(0))
    stamp = F.concat(F.lit(f"{year} "), F.replace(g(2), F.lit("  "), F.lit(" ")))
    ts = F.when(new, F.unix_timestamp(F.try_to_timestamp(part(2)))).otherwise(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss"))))
    own = F.map_filter(F.create_map(F.lit("facility"), F.floor(priority / 8).cast("string"), F.lit("pid"), part(5), F.lit("msgid"), part(6)), lambda k, x: x.isNotNull())
    data = F.when(new & (g(8) != "-"), key_values(F.regexp_replace(g(8), r"\]\[?", " "))).otherwise(F.create_map().cast(BAG))
    return events(rows, ts=ts, source=F.coalesce(part(4), F.lit("syslog")), category=F.lit("syslog"), severity=severity, host=part(3), message=F.coalesce(F.get("g", 7), v), fields=to_bag(merge(own, data)))


# S13. Firewall log types and levels.
FIREWALL_CATEGORY = {"traffic": "firewall", "utm": "ids", "event": "system", "anomaly": "ids"}
FIREWALL_SUBTYPE = {"virus": "malware", "webfilter": "web", "dns": "dns", "vpn": "vpn", "user": "auth"}
FIREWALL_LEVEL = {"emergency": 4, "alert": 4, "critical": 4, "error": 3, "warning": 2, "notice": 1, "information": 0, "debug": 0}


def normalize_kv_firewall(df: DataFrame, column: str = "value") -> DataFrame:
    """``k=v`` firewall lines to events: category from type and subtype, severity from level, time from eventtime."""
    rows = df.withColumn("_kv", key_values(F.col(column)))
    kv = lambda k: F.nullif(F.col("_kv")[k], F.lit(""))
    look = lambda table, k: F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.lower(kv(k))]
    zone = F.regexp_extract(F.coalesce(kv("tz"), F.lit("+0000")), r"([+-])(\d\d):?(\d\d)", 0)
    offset = F.when(zone == "", 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 3600 + F.right(zone, F.lit(2)).try_cast("int") * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    local = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", kv("date"), kv("time")), F.lit("yyyy-MM-dd HH:mm:ss"))) - offset
    ts = F.coalesce(epoch(kv("eventtime")), local)
    word = F.lower(kv("action"))
    action = F.when(word.isin("deny", "denied", "block", "blocked", "dropped", "reset"), "blocked").when(word.isin("accept", "allow", "allowed", "pass", "passthrough", "close"), "allowed").otherwise(word)
    bag = F.map_concat(F.map_filter("_kv", lambda k, v: k != "action"), F.map_filter(F.create_map(F.lit("action"), action), lambda k, v: v.isNotNull()))
    dedup = F.sha2(F.concat_ws("|", kv("devid"), kv("logid"), kv("eventtime"), kv("sessionid"), kv("srcip"), kv("dstip")), 256)
    return events(rows, ts=ts, source=F.lit("firewall"), category=F.coalesce(look(FIREWALL_SUBTYPE, "subtype"), look(FIREWALL_CATEGORY, "type"), F.lit("firewall")), severity=F.coalesce(look(FIREWALL_LEVEL, "level"), F.lit(0)), host=F.coalesce(kv("devname"), kv("devid")), message=F.coalesce(kv("msg"), F.col(column)), src_ip=kv("srcip"), dst_ip=kv("dstip"), url=kv("url"), dedup=dedup, fields=to_bag(bag))


# S14
def read_cold(spark: SparkSession, path: str, env: str, lo: int, hi: int) -> DataFrame:
    """Rows of an environment in [lo, hi]; only the day folders of the window are listed and read."""
    return spark.read.parquet(path).where((F.col("env_id") == env) & F.col("day").between(F.to_date(F.timestamp_seconds(F.lit(lo))), F.to_date(F.timestamp_seconds(F.lit(hi)))) & F.col("ts").between(lo, hi))
