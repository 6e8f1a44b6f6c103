"""Sharding, mixing and line dedup: DataFrame operators."""

import re
import zlib
import random
from collections import Counter, defaultdict

import pytest

from secspark.llm.lines import drop_boilerplate
from secspark.llm.mixing import in_order, mix, mix_blocks, schedule
from secspark.llm.sharding import build_map, load_map, rebalance, shard_documents, slot_totals, slotted, store_map

from .helpers import SCHEMA, as_set, rows, table


def test_shards(spark):
    data = rows(n=400)
    out = shard_documents(table(spark, data), shards=4, slots=256).collect()
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in out) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, *_ in data)
    by_shard, slots = defaultdict(int), defaultdict(list)
    for r in out:
        by_shard[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["vslot"]: r["shard"] for r in out}) == len({(r["vslot"], r["shard"]) for r in out})
    largest = max(Counter({r["vslot"]: 0 for r in out} | Counter(_sum(out))).values())
    assert max(by_shard.values()) - min(by_shard.values()) <= largest


def _sum(out):
    c = Counter()
    for r in out:
        c[r["vslot"]] += r["size"]
    return c


def test_map_versions(spark, tmp_path):
    totals = slot_totals(slotted(table(spark, n=400), 128), 128).cache()
    one = build_map(totals, 4)
    two = rebalance(one, totals, 5)
    a, b = ({r["vslot"]: r["shard"] for r in m.collect()} for m in (one, two))
    assert set(a) == set(b) == set(range(128))
    size = {r["vslot"]: r["bytes"] for r in totals.collect()}
    load = [sum(size[s] for s in b if b[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 2 * max(size.values())
    assert sum(a[s] != b[s] for s in a) < 64  # most slots stay
    three = {r["vslot"]: r["shard"] for r in rebalance(two, totals, 3).collect()}
    assert set(three.values()) == {0, 1, 2} and all(three[s] == b[s] or b[s] > 2 or load[b[s]] > 0 for s in b)
    path = f"file://{tmp_path}/map"
    store_map(one, path)
    store_map(two, path)
    assert {r["vslot"]: r["shard"] for r in load_map(spark, path).collect()} == b
    assert {r["vslot"]: r["shard"] for r in load_map(spark, path, 1).collect()} == a


def test_mix(spark):
    data = rows(n=300)
    out = mix(table(spark, data), {"a": 0.5, "b": 0.3, "c": 0.1}, block_bytes=300).collect()
    assert sorted(str((r["doc_id"], r["size"], r["source"])) for r in out) == sorted(str((i, len((t or "").encode()) + 1, s or "")) for i, t, _, s, *_ in data)
    assert sorted(r["position"] for r in out) == list(range(len(data)))
    out.sort(key=lambda r: r["position"])
    assert all(x["slot"] <= y["slot"] for x, y in zip(out, out[1:]))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    for s in {r["source"] for r in out}:
        blocks = [r["block"] for r in out if r["source"] == s]
        assert blocks == sorted(blocks)


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 1}, {"a": 0.7213, "b": 0.2, "c": 0.0787}, {"a": 1, "b": 1, "c": 5}])
def test_bytes_put_out_are_fair(spark, weights):
    """Records of ten blocks and of a tenth: until a source ends, its bytes are within one block of its share."""
    block, data, n = 1000, [], 0
    for s in weights:
        for k in range(60):
            data.append((n, "x" * ([9_999, 99, 2_500, 0][k % 4]), "en", s, 1, 1, "s", "k"))
            n += 1
    out = sorted(mix_blocks(table(spark, data), weights, block_bytes=block).collect(), key=lambda r: r["position"])
    whole = Counter()
    for r in out:
        assert 0 < r["bytes"] <= block and r["release"] <= r["slot"] < r["deadline"]
        whole[r["doc_id"]] += r["bytes"]
    assert whole == {i: len(t) + 1 for i, t, *_ in data}
    total, held, by_slot = sum(weights.values()), Counter(), defaultdict(list)
    size = Counter()
    for i, t, _, s, *_ in data:
        size[s] += len(t) + 1
    for r in out:
        by_slot[r["slot"]].append(r)
    for t in range(max(by_slot) + 1):
        assert len({r["source"] for r in by_slot[t]}) <= 1 and sum(r["bytes"] for r in by_slot[t]) <= block
        for r in by_slot[t]:
            held[r["source"]] += r["bytes"]
        if any(held[s] > size[s] - block for s in weights):
            break
        assert all(abs(held[s] - (t + 1) * block * w / total) < block * 1.001 for s, w in weights.items())
    assert t > 100


def serial(rates):
    """Earliest deadline first over all slots, one by one."""
    total, had, want = sum(r for r, _ in rates.values()), dict.fromkeys(rates, 0), []
    while any(had[s] < n for s, (_, n) in rates.items()):
        t = sum(had.values())
        due, s = min((-(-(had[s] + 1) * total // r), s) for s, (r, _) in rates.items() if had[s] * total // r <= t)
        if had[s] < rates[s][1]:
            want.append((s, had[s], had[s] * total // rates[s][0], due, t))
        had[s] += 1
    return sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_stretches_start_from_a_guess(spark, seed):
    """Many stretches over one or several periods, small whole weights and shares of 2^31."""
    r = random.Random(seed)
    top = [60, 250, 1 << 31][seed % 3]
    rates = {f"s{i}": (r.randint(top // 20 + 1, top), r.randint(1, 400)) for i in range(r.randint(2, 9))}
    df = spark.createDataFrame([(s, q, n) for s, (q, n) in rates.items()], "source string, rate long, blocks long")
    assert sorted(map(tuple, schedule(df, steps=8).collect())) == serial(rates)


def test_blocks_keep_their_size(spark):
    """Blocks of a byte: as many slots as bytes times the inverse of the share, and none of them is made but those with a block."""
    data = [(i, "x" * 2000, "en", "a" if i % 3 else "b", 1, 1, "s", "k") for i in range(12)]
    out = mix_blocks(table(spark, data), {"a": 1, "b": 9}, block_bytes=1)
    assert out.count() == 12 * 2001 and out.agg({"bytes": "max"}).first()[0] == 1
    last = out.agg({"slot": "max"}).first()[0]
    assert last == max(t for *_, t in serial({"a": (1, 8 * 2001), "b": (9, 4 * 2001)}))


def test_schedule(spark):
    """Stretches joined give the same as one run over all slots."""
    rates = {"a": (1_000_003, 90), "b": (77, 3), "c": (333_333, 40), "d": (2_000_001, 150)}
    got = schedule(spark.createDataFrame([(s, r, n) for s, (r, n) in rates.items()], "source string, rate long, blocks long"), steps=16).collect()
    assert sorted(map(tuple, got)) == serial(rates)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mix_keeps_target_weights(spark):
    """While all sources last, each has had within one block of its target, not of a rounded one."""
    weights = {"hot": 0.8714} | {f"s{i:02}": 0.0001 * (i + 1) for i in range(25)} | {"mid": 0.0961}
    total = sum(weights.values())
    data = [(k, "x" * 99, "en", s, 99, 1, "s", "k") for k, s in enumerate(s for s, w in weights.items() for _ in range(int(2_000 * w) + 1))]
    out = sorted(mix(table(spark, data), weights, block_bytes=100).collect(), key=lambda r: r["position"])
    assert len(out) == len(data)
    had, n = Counter(), Counter(d[3] for d in data)
    for r in out:
        if any(n[s] == had[s] for s in n):
            break
        had[r["source"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"]
        assert all(abs(had[s] - (r["slot"] + 1) * w / total) < 1.001 for s, w in weights.items())
    assert sum(had.values()) > 300


def test_in_order_keeps_every_row(spark):
    docs = table(spark, n=150)
    cols = docs.columns
    out = in_order(docs, block_bytes=500)
    assert out.columns == cols and as_set(out, *cols) == as_set(docs, *cols)


PAGES = "page_id long, url string, html string, host string, lines string"


def test_lines(spark):
    menu, foot = "<nav><ul><li>Home<li>About us</ul></nav>", "<p>All rights &amp; so on"
    data = [(i, f"https://A.example/{i}", f"<html>{menu}<p>Text {i}</p><br>Seen {i % 2}<script>x='</p>'</script><!-- no -->{foot}", "x", "y") for i in range(10)]
    data += [(20 + i, "http://b.example:80/?q", f"<p>Home</p><div>one {i}</div>", "x", "y") for i in range(2)]
    data += [(30, None, "<p>alone</p>", "x", "y"), (31, "http://b.example/", None, "x", "y"), (None, "bad", "", "x", "y"), (0, "https://a.example/0", data[0][2], "x", "y")]
    got = {(r["page_id"], r["host"], r["n_dropped"]): r["kept"] for r in drop_boilerplate(spark.createDataFrame(data, PAGES)).collect()}
    assert got[(3, "a.example", 4)] == ["Text 3"]
    assert got[(20, "b.example", 1)] == ["one 0"]  # on two of three pages
    assert got[(30, "", 0)] == ["alone"] and got[(31, "b.example", 0)] == []
    assert sum(1 for _ in drop_boilerplate(spark.createDataFrame(data, PAGES)).collect()) == len(data)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert shard_documents(none).count() == 0 and mix(none).count() == 0 and in_order(none).count() == 0
    assert drop_boilerplate(spark.createDataFrame([], PAGES)).count() == 0
