"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of items, text runs and media references, each with its position; a
reference keeps its digest, alternative text and the caption of its figure. Payloads stand once in a media
table and are found by a join on the digest, so that only digests and what was computed from a payload are
shuffled, never the payload itself.

A stored form is a binary portable graymap: 64 samples of 8 bits a row, the unpadded length in a comment of
the header. It holds any bytes without loss.

Defined results
- null text counts as empty; an empty payload is one row of zeros;
- equal texts have the same stored form and digest, hence equal values;
- a reference whose digest is not in the table stays in its place with a null payload;
- captions belong to the media of their figure, those of an outer figure to media without one; text outside
  figures becomes text items in order;
- the sources of a picture, audio or video are alternatives: one item stands for all of them;
- repeated rows and null ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, scratch, text_or_empty

WIDTH = 64
SCHEME = "media:"
_MEDIA = {"img", "audio", "video", "source", "embed"}
_CHOICE = {"picture", "audio", "video"}  # their sources are alternatives
_SILENT = {"script", "style", "template", "noscript"}
_BREAKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "article", "section", "figure", "header", "footer", "nav", "title", "ul", "ol", "table"}
ITEMS = "array<struct<pos:int,kind:string,text:string,src:string,caption:string>>"


def _address(attrs: dict) -> str | None:
    """Where a media tag points: its src, else the first candidate of its srcset."""
    if attrs.get("src"):
        return attrs["src"]
    first = (attrs.get("srcset") or "").split(",")[0].split()
    return first[0] if first else None


class _Sequence(HTMLParser):
    """Collects the items of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.caption = [], [], 0, None
        self.figures: list[list] = []  # open figures: media items and caption texts
        self.choices: list[list] = []  # open picture, audio and video tags: [tag, does an item stand for it, first source]

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def media(self, src, alt):
        self.flush()
        self.items.append({"kind": "media", "text": alt, "src": src, "caption": None})
        if self.figures:
            self.figures[-1].append(self.items[-1])

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif self.silent:
            pass
        elif tag in _MEDIA or tag == "picture":
            a = dict(attrs)
            src, inside = _address(a), self.choices[-1] if self.choices else None
            if tag == "source" and inside and inside[0] == "picture":
                inside[2] = inside[2] or src  # the picture's img comes last and names it
            elif tag == "source" and inside:
                if src and not inside[1]:
                    inside[1] = True
                    self.media(src, None)
            elif tag == "img" and inside and inside[0] == "picture":
                src = src or inside[2]
                if src and not inside[1]:
                    inside[1] = True
                    self.media(src, a.get("alt"))
            elif src:
                self.media(src, a.get("alt"))
            if tag in _CHOICE:
                self.choices.append([tag, bool(src) and tag != "picture", None])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure":
                self.figures.append([])

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _CHOICE:
            if any(c[0] == tag for c in self.choices):
                while True:
                    name, done, src = self.choices.pop()
                    if src and not done:
                        self.media(src, None)
                    if name == tag:
                        break
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures:
                self.figures[-1].append(text)
            else:
                self.text.append(text)
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure" and self.figures:
                figure = self.figures.pop()
                caption = " ".join(x for x in figure if isinstance(x, str)) or None
                media = [x for x in figure if not isinstance(x, str)]
                for x in media:
                    x["caption"] = x["caption"] or caption
                if caption and not media:
                    self.text.append(caption)
                    self.flush()
                if self.figures:
                    self.figures[-1] += media  # an outer caption is for those without one of their own

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Items of one page, in order."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    while p.choices:
        p.handle_endtag(p.choices[-1][0])
    if p.caption is not None:
        p.handle_endtag("figcaption")
    while p.figures:
        p.handle_endtag("figure")
    p.flush()
    return [{"pos": i} | x for i, x in enumerate(p.items)]


def _parse(batches):
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("caption", pa.string())]))
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([sequence(x) for x in b["html"].to_pylist()], kind)], names=["page_id", "items"])


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, items: the ordered text and media-reference structs of each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_parse, f"page_id long, items {ITEMS}")


def references(sequences: DataFrame) -> DataFrame:
    """page_id, pos, digest, alt, caption: one row for each media reference by digest."""
    item = sequences.select("page_id", F.explode("items").alias("x")).where((F.col("x.kind") == "media") & F.col("x.src").startswith(SCHEME))
    return item.select("page_id", F.col("x.pos").alias("pos"), F.substring("x.src", len(SCHEME) + 1, 64).alias("digest"), F.col("x.text").alias("alt"), F.col("x.caption").alias("caption"))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of the media table (one row a digest); null where there is no payload."""
    return refs.join(media, "digest", "left")


def stored_form(payload: Column) -> Column:
    """Graymap of a binary column: header with the length, then the payload with zeros up to whole rows."""
    n = F.octet_length(payload)
    rows = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int")
    header = F.concat(F.lit("P5\n# "), n.cast("string"), F.lit(f" bytes\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(header, "UTF-8"), F.rpad(payload, rows * WIDTH, F.lit(b"\x00")))


_HEADER = re.compile(rb"P5\n# (\d+) bytes\n(\d+) (\d+)\n255\n")


def read_form(data: bytes) -> tuple[int, memoryview]:
    """(unpadded length, samples) of a stored form."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a stored form")
    samples = memoryview(data)[m.end() :]
    if len(samples) != int(m[2]) * int(m[3]):
        raise ValueError("a stored form of the wrong size")
    return int(m[1]), samples


def feature(samples: memoryview) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, in thousandths."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n = int(counts.sum())
    values = np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    mean = total * 1000 // n
    variance = max(0, squares * 1_000_000 // n - mean * mean)
    bins = counts.reshape(16, 16).sum(axis=1) * 1000 // n
    return f"m{mean};v{variance};h" + ",".join(map(str, bins.tolist()))


def _describe(batches):
    for b in batches:
        out = []
        for digest, data in zip(b["digest"].to_pylist(), b["media"]):
            data = data.as_py()
            n, s = read_form(data)
            out.append((digest, n, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(s)))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe(media: DataFrame) -> DataFrame:
    """One row for each digest of (digest, media): sizes, digests and features, all from the stored bytes."""
    rows = media.select("digest", "media").mapInArrow(_describe, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    names = [c for c in rows.columns if c != "digest"]
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in names])


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media inside a page, parse the pages, join by digest; one row for each document."""
    form = stored_form(F.encode(text_or_empty(text_col), "UTF-8"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), form.alias("media"))
    rows = rows.withColumn("digest", F.sha2("media", 256))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    html = F.concat(F.lit("<article><p>Document "), name, F.lit(f'</p><figure><img src="{SCHEME}'), F.col("digest"), F.lit('" alt="document"><figcaption>Bytes of document '), name, F.lit("</figcaption></figure></article>"))
    with scratch(docs.sparkSession):  # the stored forms are a copy of the corpus: they go with it
        stored = save(rows.select("doc_id", "digest", "media", html.alias("html")), "media")
        refs = references(parse_pages(stored, "doc_id"))
        found = resolve(refs, save(describe(stored), "described"))
        return save(found.select(F.col("page_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"), "sequences", outlive=True)
