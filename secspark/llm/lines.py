"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line of a page the pages of the host that contain it are counted and
divided by the host's pages; lines above the boilerplate ratio are dropped from every page of that host.
A line's hash is counted once a page before anything is shuffled, so a hot host or a common line arrives as
one partial count from each task. The dropped lines of a host number at most its lines a page divided by
the ratio, which bounds the list that is joined back to its pages. DataFrame expressions only.

Defined results
- lines: the text between block tags of the HTML, scripts, styles, comments and tags removed, the five
  basic entities and no-break spaces resolved, trimmed; empty lines don't count;
- a null or unreadable url has the host ''; null HTML has no lines;
- a line must be on ``min_pages`` pages of the host at least, two: a line of one page repeats nothing, so a
  site of a single page keeps its text;
- repeated rows are pages of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

RATIO = 0.3
MIN_PAGES = 2
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s[^>]*)?/?>"
TAG = r"<[!/?a-zA-Z][^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def page_lines(html: Column) -> Column:
    """Array of a page's text lines."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in ((HIDDEN, ""), (BLOCK, "\n"), (TAG, "")):
        text = F.regexp_replace(text, pattern, to)
    for entity, to in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(to))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), lambda x: x != "")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, common: hashes of the lines to drop. ``pages`` has host and lines."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    once = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("h"))
    counts = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("h").alias("common"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped and the kept lines."""
    # written once: the patterns are the cost, and both the counts and the cut need the lines
    rows = save(pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines")), "lines")
    common = save(boilerplate(rows, ratio, min_pages), "boilerplate")
    joined = rows.join(common, "host", "left")
    stay = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", F.xxhash64(x))))
    return joined.withColumn("kept", stay).select("page_id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"), "kept")
