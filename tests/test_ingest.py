"""The order of ingest, and ingest as a stream that is stopped and started."""

from pyspark.sql import functions as F

from secspark.operators.ingest import Settings, ingest, ingest_stream

IOCS = "type string, value string, source string, confidence int, severity int, expires long"
ROWS = "id long, ts long, source string, host string, message string, dedup string"


def settings(spark):
    return Settings(
        regex_parsers=(("app", r"from (?<rhost>\S+)"),),
        specs=({"source": "fim", "extract": [{"json": True}], "map": {"category": "integrity", "severity": "3"}},),
        generic_sources=("fim",),
        iocs=spark.createDataFrame([("ip", "9.9.9.9", "f", 80, 3, 0)], IOCS),
        deploys=spark.createDataFrame([("a.service", "aa", 100)], "name string, hash string, deployed_at long"),
        vocabulary=("integrity",),
        version="v",
        processors=({"field": "severity", "op": "eq", "value": "3", "action": "drop"}, {"field": "source", "op": "eq", "value": "app", "action": "mask", "arg": "src_ip"}),
    )


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


DATA = [
    (1, 150, "app", "h", "from 9.9.9.9", "k"),
    (2, 151, "app", "h", "from 9.9.9.9", "k"),
    (3, 160, "fim", "h", '{"path":"/etc/a.service","hash":"aa"}', None),
    (4, 170, "fim", "h", '{"path":"/etc/a.service","hash":"bb"}', None),
    (5, None, "app", None, None, "k"),
    (6, 180, "secspark-self", "h", None, "k2"),
    (7, 140, "fim", "h", '{"path":"x","hash":"aa"}', "k3"),
    (8, 190, "other", "h", None, "k3"),
]


def test_order(spark):
    got = {r["id"]: r for r in ingest(rows(spark, DATA), settings(spark), 1).collect()}
    assert set(got) == {1, 3, 5, 6, 8}  # 4 and 7 are dropped at severity 3, 3 was lowered before; 7 doesn't hide 8; 2 is a duplicate
    assert got[1]["src_ip"] == "[redacted]" and got[1]["ti_match"] == "9.9.9.9"  # matched before it was masked
    assert got[3]["severity"] == 1 and got[3]["category_state"] == "canonical" and '"severity_original":"3"' in got[3]["fields"]
    assert got[6]["source"] == "ext:secspark-self" and got[5]["ti_match"] is None
    assert all('"cim":"v"' in r["fields"] for r in got.values())


def test_nothing_set(spark):
    got = ingest(rows(spark, DATA).select("id", "ts", "source"), Settings(), 1)
    assert got.count() == len(DATA) and "env_id" in got.columns
    assert ingest(rows(spark, []), settings(spark), 1).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}"
    parts = [DATA[:1], DATA[1:5], [], DATA[5:]]
    for part in parts:
        rows(spark, part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        live = spark.readStream.schema(ROWS).parquet(f"{path}/in")
        ingest_stream(live, settings(spark), lambda: 1, f"{path}/out", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    want = ingest(rows(spark, DATA), settings(spark), 1)
    got = spark.read.parquet(f"{path}/out/rows").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_old_keys_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}"
    for k, ts in enumerate([0, 86400 * 30, 86400 * 30 + 5]):
        rows(spark, [(k, ts, "s", "h", None, "same")]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        live = spark.readStream.schema(ROWS).parquet(f"{path}/in")
        ingest_stream(live, Settings(), lambda: 1, f"{path}/out", f"{path}/cp", 86400).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/out/rows").collect()) == [0, 1]


def test_a_batch_reads_its_steps_again(spark, tmp_path):
    """Lookups don't stand over one another in one plan, and nothing of the steps is left."""
    made = []

    def keep(df):
        made.append(len(df._jdf.queryExecution().analyzed().toString()))
        df.write.parquet(f"file://{tmp_path}/{len(made)}")
        return spark.read.parquet(f"file://{tmp_path}/{len(made)}")

    s = settings(spark)
    kept, plain = ingest(rows(spark, DATA), s, 1, keep), ingest(rows(spark, DATA), s, 1)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    assert len(made) == 3 and len(kept._jdf.queryExecution().analyzed().toString()) * 10 < len(plain._jdf.queryExecution().analyzed().toString())
    rows(spark, DATA).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in")
    ingest_stream(live, s, lambda: 1, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert not (tmp_path / "out/steps/batch=0").exists()
