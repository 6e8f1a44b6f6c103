import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from secspark.llm.langid import LEVEL, _classify, held_out, keep_identified, predict_languages, train
from secspark.llm.langid import letters as only_letters
from secspark.llm.media import describe, document_media, feature, parse_pages, read_form, references, resolve, sequence

from .helpers import SCHEMA, as_set, rows, table


def test_sequence():
    html = """<h1>T &amp; t</h1><p>one <b>two</b><img src="media:aa" alt="A">three</p><script>no</script>
    <figure><img src="media:bb"><figcaption>Cap <i>b</i></figcaption></figure><figure>x<figcaption>lonely</figcaption></figure><img><p>end"""
    got = [(x["pos"], x["kind"], x["text"], x["src"], x["caption"]) for x in sequence(html)]
    assert got == [
        (0, "text", "T & t", None, None),
        (1, "text", "one two", None, None),
        (2, "media", "A", "media:aa", None),
        (3, "text", "three", None, None),
        (4, "media", None, "media:bb", "Cap b"),
        (5, "text", "x", None, None),
        (6, "text", "lonely", None, None),
        (7, "text", "end", None, None),
    ]
    assert sequence(None) == [] and sequence("<figure><img src=x><figcaption>open")[0]["caption"] == "open"


def test_nested_figures_and_alternatives():
    html = """<figure><figure><img src="media:a"><figcaption>inner</figcaption></figure><img src="media:b"><figcaption>outer</figcaption></figure>
    <picture><source srcset="media:big 2x, media:huge 3x"><img src="media:c" alt="C"></picture><picture><source srcset="media:d 1x"><img></picture>
    <video><source src="media:e"><source src="media:f"></video><video src="media:g"><source src="media:h"></video><img srcset="media:i 1x, media:j 2x"><picture><source srcset="media:k">"""
    assert [(x["src"], x["text"], x["caption"]) for x in sequence(html) if x["kind"] == "media"] == [
        ("media:a", None, "inner"), ("media:b", None, "outer"), ("media:c", "C", None), ("media:d", None, None), ("media:e", None, None), ("media:g", None, None), ("media:i", None, None), ("media:k", None, None),
    ]
    assert [x["pos"] for x in sequence(html)] == list(range(len(sequence(html))))


def test_pages_interleave(spark):
    """The given pages, with a picture after every paragraph: order, captions and payloads stay aligned."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    pictures = [(hashlib.sha256(str(k).encode()).hexdigest(), f"payload {k}".encode()) for k in range(5)]
    html = {r["page_id"]: re.sub("(?is)<script.*?</script>|<!--.*?-->", "", r["html"] or "") for r in pages.collect()}
    for i, x in html.items():
        parts = x.split("</p>")
        html[i] = parts[0] + "".join(f'</p><figure><img src="media:{pictures[(i + k) % 5][0]}"><figcaption>{i} {k}</figcaption></figure>' + p for k, p in enumerate(parts[1:]))
    out = resolve(references(parse_pages(spark.createDataFrame(list(html.items()), "page_id long, html string"))), spark.createDataFrame(pictures, "digest string, payload binary")).collect()
    assert len(out) == sum(x.count("media:") for x in html.values()) > 200
    for r in out:
        i, k = map(int, r["caption"].split())
        assert i == r["page_id"] and bytes(r["payload"]) == pictures[(i + k) % 5][1]
    for i in html:
        mine = sorted((r["pos"], int(r["caption"].split()[1])) for r in out if r["page_id"] == i)
        assert [k for _, k in mine] == list(range(len(mine)))


def test_references_and_missing_payload(spark):
    pages = spark.createDataFrame([(1, f'<p>a<img src="media:{"0" * 64}"><img src="http://x/y.png">'), (2, None)], "page_id long, html string")
    refs = references(parse_pages(pages))
    media = spark.createDataFrame([], "digest string, media binary")
    out = resolve(refs, describe(media)).collect()
    assert [(r["page_id"], r["pos"], r["n_bytes"]) for r in out] == [(1, 1, None)]


def test_document_media(spark):
    data = rows(n=150)
    want = []
    for i, t, *_ in data:
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        form = f"P5\n# {len(raw)} bytes\n64 {len(pad) // 64}\n255\n".encode() + pad
        n, samples = read_form(form)
        assert n == len(raw) and bytes(samples) == pad
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature(samples)))
    got = document_media(table(spark, data))
    assert as_set(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == sorted(map(str, want))
    assert {(r["pos"], r["caption"].split()[0]) for r in got.collect()} == {(1, "Bytes")}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    out = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) > 0.97 * len(tested)
    again = predict_languages(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(**{k: r[k] for k in again[0].__fields__})) for r in out)


def test_sizes_by_brute_force(spark, docs):
    """Prediction and score from zstandard's own sizes, with dictionaries cut here."""
    import zstandard

    learned = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id").alias("h"), "text").collect()
    counts, dicts = Counter(r["lang"] for r in learned), {}
    for lang in counts:
        text, held = [], 0
        for r in sorted((r for r in learned if r["lang"] == lang), key=lambda r: r["h"])[:600]:
            if held < 112 << 10:
                text.append(only_letters(r["text"][: 112 << 10]))
                held += len(r["text"][: 112 << 10].encode())
        d = zstandard.ZstdCompressionDict(" ".join(text).encode()[: 112 << 10], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dicts[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    want = {}
    for r in docs.where("doc_id % 7 = 0").collect():
        data = only_letters(r["text"] or "").encode()
        if not data:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        sizes = sorted((sum(len(c.compress(data[k : k + 4096])) for k in range(0, len(data), 4096)), -counts[x], x) for x, c in dicts.items())
        want[r["doc_id"]] = (sizes[0][2], round(1 - sizes[0][0] / sizes[1][0], 9))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in predict_languages(docs).collect()}
    assert {i: got[i] for i in want} == want and len(want) > 100


def test_rejects(spark, docs):
    kept = keep_identified(docs, 0.002)
    assert kept.columns == docs.columns and docs.count() * 0.98 < kept.count() <= docs.count()


def test_long_texts_stay(spark, docs):
    """One language's text from 1 KB to 20 MB stays, with much the same score."""
    found = docs.where("lang = 'en' and text is not null").orderBy("doc_id").select("text").collect()
    words = only_letters(" ".join(r["text"] for r in found)).split()
    text = " ".join(random.Random(1).choices(words, k=6_000_000))  # no passage comes again
    assert len(text) > 20_000_000
    sizes = [1_000, 10_000, 100_000, 1_000_000, 4_000_000, 20_000_000]
    run = _classify(train(docs), LEVEL)
    batch = pa.RecordBatch.from_pydict({"row": sizes, "text": [text[:n] for n in sizes], "letter": [True] * len(sizes)})
    found = [r for b in run([batch]) for r in b.to_pylist()]
    assert [(r["row"], r["lang_pred"]) for r in found] == [(n, "en") for n in sizes]
    assert min(r["score"] for r in found) > 0.02 and found[-1]["score"] > 0.5 * found[1]["score"]


def test_unknown(spark):
    data = rows(n=60) + [(900, "123 !!!", "en", "a", 1, 1, "s", "k")]
    out = predict_languages(table(spark, data)).collect()
    assert len(out) == len(data)
    assert {r["lang_pred"] for r in out} <= {"en", "fr", "und"}
    assert {r["lang_pred"] for r in out if r["doc_id"] in (60, 61, 62, 900)} == {"und"}
    unlabelled = table(spark, data).withColumn("lang", held_out().cast("string").substr(0, 0))
    assert predict_languages(unlabelled.withColumn("lang", unlabelled.lang.substr(99, 1))).count() == len(data)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert predict_languages(none).count() == 0 and document_media(none).count() == 0 and keep_identified(none, 0.1).count() == 0
