"""Sigma rules (as Python dicts) to predicates; coverage of techniques; rule fields without data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secspark.functions.predicates import all_of, any_of, java_pattern
from secspark.functions.scalar import parent_technique, techniques

COLUMNS = ("source", "category", "host", "message", "src_ip", "dst_ip", "url", "action")
# Names of the standard's fields in the event model, log sources, levels.
FIELD_NAMES = {"CommandLine": "cmdline", "Image": "image", "ParentImage": "parent_image", "User": "user", "SourceIp": "src_ip", "DestinationIp": "dst_ip", "DestinationPort": "dst_port", "c-uri": "url", "src_ip": "src_ip", "dst_ip": "dst_ip"}
LOGSOURCE_CATEGORY = {"process_creation": "exec", "network_connection": "network", "firewall": "firewall", "webserver": "web", "proxy": "web", "dns": "dns", "file_event": "integrity", "authentication": "auth"}
LEVELS = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def _column(name: str, columns) -> Column:
    name = FIELD_NAMES.get(name, name)
    return F.col(name) if name in columns else F.get_json_object("fields", f"$['{name}']")


def _wild(value: str) -> str:
    """A value with * and ? as a LIKE pattern."""
    out = []
    for part in re.split(r"(\\[*?\\]|[*?])", value):
        out.append({"*": "%", "?": "_"}.get(part, re.sub(r"([%_\\])", r"\\\1", part[1:] if re.fullmatch(r"\\[*?\\]", part) else part)))
    return "".join(out)


def _one(c: Column, how: list[str], value) -> Column:
    if value is None:
        return c.isNull()
    if "exists" in how:
        return c.isNotNull() if value else c.isNull()
    for op, test in (("lte", c.try_cast("double") <= value), ("lt", c.try_cast("double") < value), ("gte", c.try_cast("double") >= value), ("gt", c.try_cast("double") > value)) if {"lt", "lte", "gt", "gte"} & set(how) else ():
        if op in how:
            return test
    text = str(value)
    if "re" in how:
        return c.rlike(java_pattern(text))
    pattern = _wild(text)
    pattern = f"%{pattern}%" if "contains" in how else f"{pattern}%" if "startswith" in how else f"%{pattern}" if "endswith" in how else pattern
    return c.ilike(pattern)


def _item(key: str, value, columns) -> Column:
    name, *how = key.split("|")
    values = value if isinstance(value, list) else [value]
    tests = [F.coalesce(_one(_column(name, columns), how, v), F.lit(False)) for v in values]
    return all_of(tests) if "all" in how else any_of(tests)


def _selection(body, columns) -> Column:
    if isinstance(body, dict):
        return all_of([_item(k, v, columns) for k, v in body.items()])
    if all(isinstance(x, dict) for x in body):
        return any_of([_selection(x, columns) for x in body])
    return any_of([F.coalesce(F.col("message").ilike(f"%{_wild(str(x))}%"), F.lit(False)) for x in body])


_WORDS = re.compile(r"\b(?:all|any|1)\s+of\s+[\w*]+|[\w*]+|[()]|\S", re.I)
_BINDS = {"or": 1, "and": 2, "not": 3}
MAX_CONDITION = 2000


def _named(word: str, found: dict[str, Column]) -> Column:
    """A selection, or ``all of x*``, ``1 of x*``, ``1 of them`` over those whose names fit."""
    several = re.fullmatch(r"(all|any|1)\s+of\s+([\w*]+)", word, re.I)
    how, wanted = several.groups() if several else ("", word)
    some = [k for k in found if k == wanted or how and (wanted == "them" or re.fullmatch(wanted.replace("*", ".*"), k))]
    if not some:
        raise ValueError(f"no selection named {wanted}")
    return (all_of if how.lower() == "all" else any_of)([found[k] for k in some])


def _condition(condition: str, found: dict[str, Column]) -> Column:
    """and, or, not, parentheses, ``all of x*`` and ``1 of x*`` over the selections, as a fold over the words.

    Words wait until one comes that binds no tighter. Conditions of over ``MAX_CONDITION`` words are refused.
    """
    words = _WORDS.findall(re.sub(r"\s+", " ", condition))
    wrong = ValueError(f"not a condition: {condition[:200]}")
    if len(words) > MAX_CONDITION:
        raise wrong
    values: list[Column] = []
    waiting: list[str] = []
    value_next = True

    def settle() -> None:
        sign = waiting.pop()
        right = values.pop()
        values.append(~right if sign == "not" else values.pop() & right if sign == "and" else values.pop() | right)

    for word in words:
        sign = word.lower()
        if value_next != (sign in ("not", "(") or sign not in ("and", "or", ")")):
            raise wrong
        if sign == "not" and waiting and waiting[-1] == "not":
            waiting.pop()  # twice is nothing
        elif sign in ("not", "("):
            waiting.append(sign)
        elif sign in ("and", "or"):
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[sign]:
                settle()
            waiting.append(sign)
            value_next = True
        elif sign == ")":
            while waiting and waiting[-1] != "(":
                settle()
            if not waiting:
                raise wrong
            waiting.pop()
        else:
            values.append(_named(word, found))
            value_next = False
    while waiting and not value_next:
        if waiting[-1] == "(":
            raise wrong
        settle()
    if value_next or len(values) != 1:
        raise wrong
    return values[0]


def sigma_predicate(doc: dict, columns=COLUMNS) -> Column:
    """The detection of a rule as one predicate; its log source narrows the category."""
    d = doc["detection"]
    found = {k: _selection(v, columns) for k, v in d.items() if k not in ("condition", "timeframe")}
    out = _condition(d["condition"], found)
    category = LOGSOURCE_CATEGORY.get(doc.get("logsource", {}).get("category", ""))
    if category and "category" in columns:
        from secspark.functions.predicates import category as with_aliases

        out &= with_aliases(category)
    return out


def sigma_severity(doc: dict) -> int:
    return LEVELS.get(str(doc.get("level", "medium")).lower(), 2)


def sigma_techniques(doc: dict) -> list[str]:
    return sorted({t[7:].upper() for t in doc.get("tags", []) if re.fullmatch(r"attack\.t\d+(\.\d+)?", t.lower())})


def sigma_fields(doc: dict) -> set[str]:
    """Model names of the fields a rule refers to."""
    out: set[str] = set()

    def walk(x):
        if isinstance(x, dict):
            out.update(FIELD_NAMES.get(k.split("|")[0], k.split("|")[0]) for k in x)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    for k, v in doc["detection"].items():
        if k not in ("condition", "timeframe"):
            walk(v)
    return out


def sigma_coverage_delta(before: DataFrame, imported: DataFrame) -> DataFrame:
    """Parent techniques that the imported rules add."""
    t = lambda d: d.select(F.explode(F.transform(techniques(F.col("mitre")), parent_technique)).alias("technique")).distinct()
    return t(imported).join(t(before), "technique", "left_anti")


def observed_fields(df: DataFrame) -> DataFrame:
    """Names of columns and bag members that hold a value anywhere; one pass for columns, one aggregate for the bag."""
    bag = df.select(F.explode(F.map_keys(F.from_json("fields", "map<string,string>"))).alias("field")).distinct()
    here = [c for c in COLUMNS if c in df.columns]
    counts = df.agg(*[F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in here])
    held = counts.select(F.explode(F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in here]), lambda x: x.isNotNull())).alias("field"))
    return bag.union(held).distinct()


def inert_fields(rule_fields: DataFrame, observed: DataFrame) -> DataFrame:
    """rule, field pairs that no data fills."""
    return rule_fields.join(observed, "field", "left_anti")
