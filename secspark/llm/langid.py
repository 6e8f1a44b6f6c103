"""Language identification by compression.

For each language one raw-content zstandard dictionary is filled with labelled texts. A text is put in lower
case, everything but letters becomes one space, and the whole of it is compressed with every dictionary, in
pieces of ``PIECE`` bytes that each start from the fresh dictionary, so that a dictionary helps a long text
as much as a short one; the language with the smallest sum wins. The score is the margin: how much smaller
the result is than the second smallest, as a share. Narrow margins can be rejected.

The sample is bounded by ``docs_per_lang`` and ``dict_bytes`` (parameters): whole texts of a language in the
order of the hashes of their ids, whatever the size of the data, until its dictionary is full. Everything
else reads all rows, and all texts are treated alike whatever their length.

Defined results
- null text, or text without a letter: ``und`` with score 0;
- equal sizes: the language with more labelled rows, then the first by name, score 0;
- no labelled row at all: ``und`` for every text;
- repeated rows and null ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .substring import _slices

DOCS_PER_LANG = 600
DICT_BYTES = 112 << 10
PIECE = 4 << 10
LEVEL = 9
UNKNOWN = "und"
LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Languages of ``labelled`` with their dictionaries, the most frequent language first."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = dict(rows.groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return []
    steps = 1 << 20
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(steps, -(-8 * docs_per_lang * steps // n)))])
    # no more of a text than a dictionary holds
    few = rows.where(F.pmod("h", F.lit(steps)) < part[F.col("lang")]).select("lang", "h", F.substring("text", 1, dict_bytes).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    ranked = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang)
    held = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("held", held).where(F.col("held") < dict_bytes)
    found: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "r").collect():  # twice dict_bytes for each language at most
        found.setdefault(r["lang"], []).append(letters(r["text"]))
    return [(k, " ".join(found[k]).encode()[:dict_bytes]) for k in sorted(counts, key=lambda k: (-counts[k], k)) if k in found]


def _classify(model: list[tuple[str, bytes]], level: int):
    def run(batches):
        import zstandard

        def coder(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        coders = [(k, coder(x)) for k, x in model if x]
        for whole in batches:
            for b in _slices(whole, "text"):
                langs, scores = [], []
                for text, ok in zip(b["text"].to_pylist(), b["letter"].to_pylist()):
                    if not ok or not coders:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    data = letters(text).encode()
                    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
                    sizes = sorted((sum(len(c.compress(x)) for x in pieces), i) for i, (_, c) in enumerate(coders))
                    langs.append(coders[sizes[0][1]][0])
                    scores.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
                yield pa.RecordBatch.from_arrays([b["row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def classify(docs: DataFrame, model: list[tuple[str, bytes]], carry: list[Column], level: int = LEVEL, text_col: str = "text") -> DataFrame:
    """struct ``row`` of the carried columns, lang_pred, score."""
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*carry).alias("row"), text.alias("text"), text.rlike(LETTER).alias("letter"))
    return rows.mapInArrow(_classify(model, level), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Is crc32 of the id as text in the held-out fold? A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def predict_languages(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), docs_per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = classify(docs, model, [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")], text_col=text_col)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_margin: float, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is found with at least ``min_margin``."""
    model = train(docs, docs_per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = classify(docs, model, [F.col(f"`{c}`") for c in docs.columns], text_col=text_col)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_margin)).select("row.*")
