"""Predicates of the search language. All keep three-valued logic; all can be pushed to the scan where Spark can."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN = 512
# Synonyms of categories at read time.
CATEGORY_ALIASES = {"exec": ("exec", "process")}


def _like(pattern: str) -> str:
    """A ``*`` wildcard as a LIKE pattern."""
    return re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%")


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def eq(c: Column, value) -> Column:
    """Equality; text with ``*`` is a wildcard and ignores case; a lone ``*`` asks for presence."""
    if isinstance(value, str) and "*" in value:
        return exists(c) if value == "*" else c.ilike(_like(value))
    return c == value


def ne(c: Column, value) -> Column:
    """Inequality; null rows don't match."""
    return ~eq(c, value)


def gt(c: Column, value) -> Column:
    return c.try_cast("double") > value


def ge(c: Column, value) -> Column:
    return c.try_cast("double") >= value


def lt(c: Column, value) -> Column:
    return c.try_cast("double") < value


def le(c: Column, value) -> Column:
    return c.try_cast("double") <= value


def java_pattern(pattern: str) -> str:
    """Named groups in Java's spelling; too long a pattern is an error."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"pattern of {len(pattern)} characters; at most {MAX_PATTERN}")
    return pattern.replace("(?P<", "(?<")


def regex(c: Column, pattern: str) -> Column:
    """Regex search; false on null."""
    return F.coalesce(c.cast("string").rlike(java_pattern(pattern)), F.lit(False))


def isin(c: Column, values) -> Column:
    return c.isin(list(values))


def not_in(c: Column, values) -> Column:
    return ~c.isin(list(values))


def free_text(term: str, column: str = "message") -> Column:
    """Substring of the message, ignoring case; ``*`` matches everything."""
    return F.lit(True) if term == "*" else F.col(column).ilike(f"%{_like(term)}%")


def exists(c: Column) -> Column:
    return c.isNotNull()


def category(name: str, column: str = "category") -> Column:
    """Category with its read-time synonyms."""
    return F.col(column).isin(list(CATEGORY_ALIASES.get(name, (name,))))


def octet_prefix(cidr: str) -> tuple[str, bool]:
    """(text, is it a prefix) of an address, ``10.0.*`` or CIDR; a mask widens to whole octets."""
    if cidr.endswith("*"):
        return cidr.rstrip("*"), True
    if "/" not in cidr:
        return cidr, False
    ip, bits = cidr.split("/")
    n = int(bits) // 8
    return (ip, False) if n >= 4 else (".".join(ip.split(".")[:n]) + "." if n else "", True)


def ipv4(c: Column) -> Column:
    """Dotted address as a number; null where it isn't one."""
    p = F.split(c, r"\.")
    ok = c.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, ((p[0].cast("long") * 256 + p[1].cast("long")) * 256 + p[2].cast("long")) * 256 + p[3].cast("long"))


def in_network(c: Column, network: str, mode: str = "prefix") -> Column:
    """Address in a network: ``prefix`` widens masks to octets, ``cidr`` is exact."""
    if mode == "cidr" and "/" in network:
        ip, bits = network.split("/")
        a, b, d, e = (int(x) for x in ip.split("."))
        size = 1 << (32 - int(bits))
        base = ((a << 24) + (b << 16) + (d << 8) + e) // size
        return F.floor(ipv4(c) / size) == base
    text, prefix = octet_prefix(network)
    return c.startswith(text) if prefix else c == text
