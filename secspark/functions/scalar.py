"""Scalar functions with the semantics of the search language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has: for columns of an operator's own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def if_(condition: Column, then, other) -> Column:
    """``then`` where the condition is true; a null condition counts as false."""
    return F.when(condition, then).otherwise(other)


def ifnull(a: Column, b) -> Column:
    return F.coalesce(a, b if isinstance(b, Column) else F.lit(b))


def _any_null(columns) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def min_(*columns: Column) -> Column:
    """Smallest argument; null if any argument is null."""
    return F.when(~_any_null(columns), F.least(*columns))


def max_(*columns: Column) -> Column:
    """Largest argument; null if any argument is null."""
    return F.when(~_any_null(columns), F.greatest(*columns))


def substr(s: Column, start: int, length: int) -> Column:
    """1-based substring."""
    return F.substring(s, start, length)


def replace(s: Column, old: str, new: str) -> Column:
    """Literal replacement."""
    return F.replace(s, F.lit(old), F.lit(new))


def re_cap(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where the pattern doesn't match."""
    from secspark.functions.predicates import java_pattern

    java = java_pattern(pattern)
    return F.when(s.rlike(java), F.regexp_extract(s, java, group))


def number(c: Column) -> Column:
    """Text as a double; null where it is not a number."""
    return c.try_cast("double")


def bucket(ts: Column, span: int) -> Column:
    """Start of the time bucket."""
    return F.floor(ts / span) * span


def hour_floor(ts: Column) -> Column:
    return bucket(ts, 3600)


def hour_ceil(ts: Column) -> Column:
    return F.ceil(ts / 3600) * 3600


def iso_epoch(s: Column) -> Column:
    """ISO 8601 text to epoch seconds, fraction and zone ignored (UTC); null where it can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(F.replace(F.substring(s, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))


def epoch(x: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds to epoch seconds; null unless positive."""
    v = x.try_cast("double")
    scaled = F.when(v > 1e17, v / 1e9).when(v > 1e14, v / 1e6).when(v > 1e12, v / 1e3).otherwise(v)
    return F.when(v > 0, F.floor(scaled))


def techniques(mitre: Column) -> Column:
    """Techniques of a tag with several, separated by comma, semicolon or white space."""
    return F.filter(F.split(F.coalesce(mitre, F.lit("")), r"[,;\s]+"), lambda x: x != "")


def parent_technique(t: Column) -> Column:
    """T1059.001 to T1059; a tag that isn't a technique stays as it is."""
    p = F.regexp_extract(t, r"^(T\d+)", 1)
    return F.when(p != "", p).otherwise(t)


def compliance_pairs(c: Column) -> Column:
    """``framework:control`` items, separated by comma or semicolon, as an array of structs."""
    items = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s*[,;]\s*"), lambda x: F.trim(x) != "")
    return F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("framework"), F.when(F.instr(x, ":") > 0, F.trim(F.regexp_replace(x, "^[^:]*:", ""))).alias("control")))
