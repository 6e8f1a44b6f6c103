"""Search, aggregation, join and function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.functions import scalar as S
from secspark.operators.search import Search, anti_join, in_ranges, metric, search_bar, semi_join, uncased, union_distinct, union_hot_cold

from .base import T0, T1, Registry, ev, table

R = Registry()

def K():
    return F.get_json_object("fields", "$.k")



@R.add("slice1_top_failed_sources", "SELECT src_ip, count(*) AS count FROM ev WHERE action = 'failure' GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 20")
def _(spark, d):
    return Search(ev(spark, d)).search(P.eq(F.col("action"), "failure")).stats("count", by=["src_ip"]).sort("-count", "src_ip").head(20).df


@R.add("q01_search_bounds", f"SELECT id, ts FROM ev WHERE ts >= {T0} AND ts <= {T0 + 86400}")
def _(spark, d):
    return Search(ev(spark, d, T0, T0 + 86400)).search(start=T0, end=T0 + 86400).fields("id", "ts").df


@R.add("q02_metric", f"SELECT ts, source AS name, value, host FROM ev WHERE source = 'purchase' AND ts >= {T0}")
def _(spark, d):
    m = ev(spark, d, T0).select("ts", F.col("source").alias("name"), F.to_json(F.struct("host")).alias("labels"), "value")
    return metric(m, "purchase", ["host"], start=T0).drop("labels")


@R.add("q03_eq_wildcard", "SELECT id FROM ev WHERE host = 'h3' AND src_ip ILIKE '10.0.3.%'")
def _(spark, d):
    return Search(ev(spark, d)).search(P.eq(F.col("host"), "h3"), P.eq(F.col("src_ip"), "10.0.3.*")).fields("id").df


@R.add("q04_ne", "SELECT id, source FROM ev WHERE source <> 'view' AND NOT (host ILIKE 'h1%')")
def _(spark, d):
    return Search(ev(spark, d)).search(P.ne(F.col("source"), "view"), P.ne(F.col("host"), "h1*")).fields("id", "source").df


@R.add("q05_numeric", "SELECT id FROM ev WHERE TRY_CAST(json_extract_string(fields, '$.k') AS DOUBLE) >= 50 AND TRY_CAST(json_extract_string(fields, '$.k') AS DOUBLE) < 60 AND value > 10 AND value <= 200")
def _(spark, d):
    return Search(ev(spark, d)).search(P.ge(K(), 50), P.lt(K(), 60), P.gt(F.col("value"), 10), P.le(F.col("value"), 200)).fields("id").df


@R.add("q06_regex", "SELECT count(*) AS count FROM ev WHERE regexp_matches(src_ip, '^10\\.0\\.[1-3]\\.1\\d\\d$')")
def _(spark, d):
    return Search(ev(spark, d)).search(P.regex(F.col("src_ip"), r"^10\.0\.[1-3]\.1\d\d$")).stats("count").df


@R.add("q06b_regex_json", "SELECT count(*) AS count FROM ev WHERE regexp_matches(json_extract_string(fields, '$.k'), '^[1-4]7$')")
def _(spark, d):
    return Search(ev(spark, d)).search(P.regex(K(), "^[1-4]7$")).stats("count").df


@R.add("q07_in", "SELECT id FROM ev WHERE source IN ('error', 'signup') AND host NOT IN ('h1', 'h2')")
def _(spark, d):
    return Search(ev(spark, d)).search(P.isin(F.col("source"), ["error", "signup"]), P.not_in(F.col("host"), ["h1", "h2"])).fields("id").df


@R.add("q08_free_text", "SELECT count(*) AS count FROM documents WHERE text ILIKE '%tion the%'", events=False)
def _(spark, d):
    return Search(table(spark, d, "documents")).search(P.free_text("TION the", "text")).stats("count").df


@R.add("q09_exists", "SELECT count(*) AS count FROM ev WHERE json_extract_string(fields, '$.k') IS NOT NULL AND json_extract_string(fields, '$.none') IS NULL")
def _(spark, d):
    return Search(ev(spark, d)).search(P.eq(K(), "*"), ~P.exists(F.get_json_object("fields", "$.none"))).stats("count").df


@R.add("q10_alias_category", "SELECT id FROM (SELECT id, CASE source WHEN 'click' THEN 'process' WHEN 'error' THEN 'exec' ELSE 'auth' END AS category FROM ev) WHERE category IN ('exec', 'process')")
def _(spark, d):
    c = F.when(F.col("source") == "click", "process").when(F.col("source") == "error", "exec").otherwise("auth")
    return Search(ev(spark, d)).eval(category=c).where(P.category("exec")).fields("id").df


_WORDS = "list_contains(regexp_split_to_array(lower(text), '\\W+'), 'the')"


@R.add("q11_search_bar", f"SELECT id, ts FROM (SELECT doc_id AS id, doc_id AS ts, text AS message, source, lang AS category FROM documents) WHERE list_contains(regexp_split_to_array(lower(message), '\\W+'), 'the') AND category = 'en' AND NOT (source = 'src1') AND regexp_matches(message, '[0-9]{{3}}') ORDER BY ts DESC, id DESC LIMIT 50", events=False)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), F.col("text").alias("message"), "source", F.col("lang").alias("category"))
    return search_bar(docs, "The cat=en source!=src1 ~[0-9]{3}", 50).select("id", "ts")


@R.add("q12_search_bar_values", "SELECT id FROM ev WHERE list_contains(regexp_split_to_array(lower(source), '\\W+'), '42') OR json_extract_string(fields, '$.k') = '42' ORDER BY ts DESC, id DESC LIMIT 100")
def _(spark, d):
    return search_bar(ev(spark, d).withColumn("message", F.col("source")), "42", 100, values=True).select("id")


@R.add("q13_where_after_stats", "SELECT host, count(*) AS count FROM ev GROUP BY host HAVING count(*) > 40")
def _(spark, d):
    return Search(ev(spark, d)).stats("count", by=["host"]).where(F.col("count") > 40).df


@R.add("q15_rename_eval", "SELECT id, host AS machine, round(value * 2, 1) AS twice FROM ev")
def _(spark, d):
    return Search(ev(spark, d)).rename(machine="host").eval(twice=F.round(F.col("value") * 2, 1)).fields("id", "machine", "twice").df


@R.add("q17_rex", "SELECT id, nullif(regexp_extract(src_ip, '^10\\.0\\.([0-4])\\.(\\d+)$', 1), '') AS net, nullif(regexp_extract(src_ip, '^10\\.0\\.([0-4])\\.(\\d+)$', 2), '') AS machine FROM ev")
def _(spark, d):
    return Search(ev(spark, d)).rex("src_ip", r"^10\.0\.(?P<net>[0-4])\.(?P<machine>\d+)$").fields("id", "net", "machine").df


@R.add("q18_exclude", "SELECT id FROM ev WHERE NOT (src_ip LIKE '10.0.1.%' OR src_ip LIKE '10.0.2.%' OR src_ip = '10.0.3.4') AND host <> 'h7'")
def _(spark, d):
    return Search(ev(spark, d)).exclude("src_ip", ["10.0.1.0/24", "10.0.2.*", "10.0.3.4"], ["h7"]).fields("id").df


@R.add("q18b_exclude_cidr", "SELECT id FROM ev WHERE CAST(split_part(src_ip, '.', 3) AS INT) NOT IN (4, 5, 6, 7)")
def _(spark, d):
    return Search(ev(spark, d)).exclude("src_ip", ["10.0.4.0/22"], mode="cidr").fields("id").df


@R.add("a01_stats", "SELECT source, host, count(*) AS count, sum(value) AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max FROM ev GROUP BY source, host")
def _(spark, d):
    return Search(ev(spark, d)).stats("count", ("sum", "value"), ("avg", "value"), ("min", "value"), ("max", "value"), by=["source", "host"]).df


@R.add("a03_dc", "SELECT source, count(DISTINCT host) AS dc FROM ev GROUP BY source")
def _(spark, d):
    return Search(ev(spark, d)).stats(("dc", "host"), by=["source"]).df


@R.add("a04_values_list", "SELECT src_ip, list_sort(list(DISTINCT source)) AS values, list(source ORDER BY ts, id) AS list FROM ev WHERE action = 'failure' GROUP BY src_ip")
def _(spark, d):
    return Search(ev(spark, d)).search(F.col("action") == "failure").stats(("values", "source"), ("list", "source"), by=["src_ip"]).df


@R.add("a06_timechart", "SELECT ts // 3600 * 3600 AS bucket, source, count(*) AS count, sum(value) AS sum FROM ev GROUP BY ALL")
def _(spark, d):
    return Search(ev(spark, d)).timechart(3600, "count", ("sum", "value"), by=["source"]).df


@R.add("a07_eventstats", "SELECT id, host, count(*) OVER (PARTITION BY host) AS count, avg(value) OVER (PARTITION BY host) AS avg FROM ev")
def _(spark, d):
    return Search(ev(spark, d)).eventstats("count", ("avg", "value"), by=["host"]).fields("id", "host", "count", "avg").df


@R.add("a07b_eventstats_dc", "SELECT id, source, (SELECT count(DISTINCT b.src_ip) FROM ev b WHERE b.source = ev.source) AS dc FROM ev")
def _(spark, d):
    return Search(ev(spark, d)).eventstats(("dc", "src_ip"), by=["source"]).fields("id", "source", "dc").df


@R.add("a08_top", "SELECT src_ip, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM ev) AS percent FROM ev GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 15")
def _(spark, d):
    return Search(ev(spark, d)).top("src_ip", 15).df


@R.add("a08b_rare", "SELECT src_ip, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM ev) AS percent FROM ev GROUP BY src_ip ORDER BY count, src_ip LIMIT 15")
def _(spark, d):
    return Search(ev(spark, d)).rare("src_ip", 15).df


@R.add("a09_rate", "SELECT ts // 3600 * 3600 AS bucket, source, count(*) / 3600.0 AS rate FROM ev GROUP BY ALL")
def _(spark, d):
    return Search(ev(spark, d)).rate(3600, ["source"]).df


@R.add("a10_dedup", "SELECT host, source, id, ts FROM ev QUALIFY row_number() OVER (PARTITION BY host, source ORDER BY ts DESC, id) = 1")
def _(spark, d):
    return Search(ev(spark, d)).sort("-ts").dedup("host", "source").fields("host", "source", "id", "ts").df


@R.add("a11_sort_head", "SELECT id, severity, value FROM ev ORDER BY severity DESC, value, id LIMIT 25")
def _(spark, d):
    return Search(ev(spark, d)).sort("-severity", "value", "id").head(25).fields("id", "severity", "value").df


@R.add("a13_keyset_page", f"SELECT id, ts FROM ev WHERE ts < {T1 - 864000} OR (ts = {T1 - 864000} AND id < 500) ORDER BY ts DESC, id DESC LIMIT 201")
def _(spark, d):
    return Search(ev(spark, d)).keyset_page(200, (T1 - 864000, 500)).fields("id", "ts").df


@R.add("a14_offset_page", "SELECT id FROM ev ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def _(spark, d):
    return Search(ev(spark, d)).offset_page(50, 100).fields("id").df


@R.add("a14b_count_total", "SELECT count(*) AS total FROM ev WHERE severity >= 2")
def _(spark, d):
    return Search(ev(spark, d)).search(F.col("severity") >= 2).count_total()


@R.add("a15_mvexpand", "SELECT source, v AS tags, count(*) AS count FROM (SELECT source, unnest([host, action]) AS v FROM ev) GROUP BY ALL")
def _(spark, d):
    return Search(ev(spark, d)).eval(tags=F.concat_ws(", ", "host", "action")).mvexpand("tags").stats("count", by=["source", "tags"]).df


@R.add("j01_join", "SELECT src_ip, a.n AS n, b.failed AS failed FROM (SELECT src_ip, count(*) AS n FROM ev GROUP BY src_ip) a JOIN (SELECT src_ip, count(*) AS failed FROM ev WHERE action = 'failure' GROUP BY src_ip) b USING (src_ip)")
def _(spark, d):
    e = ev(spark, d)
    failed = Search(e).search(F.col("action") == "failure").stats("count", by=["src_ip"]).rename(failed="count")
    return Search(e).stats("count", by=["src_ip"]).rename(n="count").join(failed, "src_ip").df


@R.add("j02_lookup", "SELECT c_custkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20", events=False)
def _(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20")
    t = n.select(F.col("n_nationkey").cast("string").alias("key"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))).alias("val"))
    c = table(spark, d, "customer").withColumn("nk", F.col("c_nationkey").cast("string"))
    return Search(c).auto_lookup([(t, "nk", ["name", "region"])]).fields("c_custkey", "name", "region").df


@R.add("j04_append", "SELECT host, count(*) AS count, NULL AS source FROM ev GROUP BY host UNION ALL SELECT NULL, count(*), source FROM ev GROUP BY source")
def _(spark, d):
    e = Search(ev(spark, d))
    return e.stats("count", by=["host"]).append(e.stats("count", by=["source"])).df


@R.add("j05_anti_join", "SELECT DISTINCT src_ip FROM ev WHERE action = 'failure' AND src_ip NOT IN (SELECT src_ip FROM ev WHERE source = 'signup' AND id % 3 = 0)")
def _(spark, d):
    e = ev(spark, d)
    return anti_join(e.where("action = 'failure'").select("src_ip").distinct(), e.where("source = 'signup' and id % 3 = 0"), "src_ip")


@R.add("j06_semi_join", "SELECT DISTINCT src_ip FROM ev WHERE action = 'failure' AND src_ip IN (SELECT src_ip FROM ev WHERE source = 'signup')")
def _(spark, d):
    e = ev(spark, d)
    return semi_join(e.where("action = 'failure'").select("src_ip").distinct(), e.where("source = 'signup'"), "src_ip")


@R.add("j07_uncased", "SELECT id FROM ev WHERE severity = 3 AND id % 3 <> 0")
def _(spark, d):
    e = ev(spark, d)
    items = e.where("severity = 3 and id % 3 = 0").select(F.concat(F.lit("alert:"), "id").alias("ref"))
    return uncased(e.where("severity = 3").select("id"), items)


@R.add("j08_range_join", f"SELECT id FROM ev WHERE (source = 'error' AND ts BETWEEN {T0} AND {T0 + 200000}) OR (source = 'click' AND ts BETWEEN {T0 + 100000} AND {T0 + 300000})")
def _(spark, d):
    ranges = spark.createDataFrame([("error", T0, T0 + 200000), ("click", T0 + 100000, T0 + 300000)], "s string, a long, b long")
    e = ev(spark, d)
    return in_ranges(e, F.broadcast(ranges), (F.col("source") == F.col("s")) & F.col("ts").between(F.col("a"), F.col("b"))).select("id")  # two rows


@R.add("j09_union_hot_cold", "SELECT source, count(*) AS count FROM ev GROUP BY source")
def _(spark, d):
    e = ev(spark, d)
    return Search(union_hot_cold(e.where(F.col("ts") >= T0 - 3600), e.where(F.col("ts") < T0 + 3600), T0)).stats("count", by=["source"]).df


@R.add("j10_union_distinct", "SELECT src_ip FROM ev WHERE source = 'error' UNION SELECT src_ip FROM ev WHERE source = 'purchase' AND value > 100")
def _(spark, d):
    e = ev(spark, d)
    return union_distinct(e.where("source = 'error'").select("src_ip"), e.where("source = 'purchase' and value > 100").select("src_ip"))


@R.add(
    "f01_functions",
    """SELECT id, CASE WHEN severity > 2 THEN 'bad' ELSE 'fine' END AS f_if, coalesce(nullif(source, 'view'), 'none') AS f_coalesce, upper(host) AS f_upper,
    length(src_ip) AS f_length, abs(value - 100) AS f_abs, CASE WHEN nullif(source, 'view') IS NULL THEN NULL ELSE least(severity, 1) END AS f_min,
    CASE WHEN nullif(source, 'view') IS NULL THEN NULL ELSE greatest(severity, 1) END AS f_max, substr(src_ip, 2, 4) AS f_substr, replace(src_ip, '.', '-') AS f_replace,
    trim('  ' || host || ' ') AS f_trim, ts // 3600 * 3600 AS f_floor, (ts + 3599) // 3600 * 3600 AS f_ceil FROM ev""",
)
def _(spark, d):
    c, maybe = F.col, F.when(F.nullif(F.col("source"), F.lit("view")).isNotNull(), F.lit(1))
    return ev(spark, d).select(
        "id", S.if_(c("severity") > 2, "bad", "fine").alias("f_if"), S.ifnull(F.nullif(c("source"), F.lit("view")), "none").alias("f_coalesce"), F.upper("host").alias("f_upper"), F.length("src_ip").alias("f_length"),
        F.abs(c("value") - 100).alias("f_abs"), S.min_(c("severity"), maybe).alias("f_min"), S.max_(c("severity"), maybe).alias("f_max"), S.substr(c("src_ip"), 2, 4).alias("f_substr"), S.replace(c("src_ip"), ".", "-").alias("f_replace"),
        F.trim(F.concat(F.lit("  "), "host", F.lit(" "))).alias("f_trim"), S.hour_floor(c("ts")).alias("f_floor"), S.hour_ceil(c("ts")).alias("f_ceil"),
    )


@R.add("f12_times", "SELECT id, ts AS iso, ts AS from_ms FROM ev")
def _(spark, d):
    e = ev(spark, d)
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'.123Z'")
    return e.select("id", S.iso_epoch(iso).alias("iso"), S.epoch((F.col("ts") * 1000).cast("string")).alias("from_ms"))
