"""Search: a fluent chain of DataFrame stages.

Each stage is a lazy DataFrame step and is recorded, so that a rule can be drilled into and masks can be
checked against the columns a chain refers to. No stage collects; no limit stands before an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.functions.scalar import bucket, unused
from secspark.model import DEFAULT_ENV, SEVERITY_NAMES

# Aliases of field names in the search bar.
BAR_ALIASES = {"cat": "category", "sev": "severity", "ip": "src_ip", "msg": "message"}


def aggregate(name: str, column: str | None = None, *, approx: bool = False, order: tuple[str, ...] = ("ts", "id")) -> Column:
    """One of count, sum, avg, min, max, dc, values, list, named by the function."""
    c = F.col(column) if column else None
    if name == "count":
        return (F.count("*") if c is None else F.count(c)).alias("count")
    if name == "list":
        keys = [F.col(k).alias(f"_{i}") for i, k in enumerate(order)]
        ordered = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*keys, c.alias("v")))))
        return F.transform(ordered, lambda x: x["v"]).alias("list")
    made = {
        "sum": lambda: F.sum(c),
        "avg": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "dc": lambda: F.approx_count_distinct(c) if approx else F.countDistinct(c),
        "values": lambda: F.array_sort(F.collect_set(c)),
    }[name]()
    return made.alias(name)


def _aggs(aggs) -> list[Column]:
    return [a if isinstance(a, Column) else aggregate(*((a,) if isinstance(a, str) else a)) for a in aggs]


def _aggregated(aggs) -> tuple[tuple[str, Column | str | None], ...]:
    """(name, what it is made of) of aggregates; a Column stands for itself under no name of its own."""
    return tuple(("", a) if isinstance(a, Column) else (a if isinstance(a, str) else a[0], None if isinstance(a, str) or len(a) < 2 else a[1]) for a in aggs)


def _grouped(aggs, by, *more) -> Note:
    made = (*_aggregated(aggs), *more)
    return Note(made=made, only=(*by, *(n for n, _ in made)))


@dataclass(frozen=True)
class Note:
    """What a stage does to fields, for masks: what it filters by, what it makes out of what, and what it renames."""

    filters: tuple[Column | str, ...] = ()
    made: tuple[tuple[str, Column | str | None], ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    only: tuple[str, ...] | None = None
    sub: Search | DataFrame | None = None
    again: Callable[[DataFrame, DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Search:
    df: DataFrame
    stages: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()
    order: tuple[Column, ...] = attr(default=())
    notes: tuple[Note, ...] = ()
    base: DataFrame | None = None

    def _then(self, name: str, step: Callable[[DataFrame], DataFrame], order=None, note: Note = Note()) -> Search:
        return Search(step(self.df), (*self.stages, (name, step)), self.order if order is None else order, (*self.notes, note), self.df if self.base is None else self.base)

    # predicates and projections
    def search(self, *predicates: Column, start: int = 0, end: int = 0, env: str | None = None) -> Search:
        """Base scan; bounds are inclusive and 0 leaves a side open."""
        tests = list(predicates)
        if start:
            tests.append(F.col("ts") >= start)
        if end:
            tests.append(F.col("ts") <= end)
        if env is not None:
            tests.append(F.coalesce("env_id", F.lit(DEFAULT_ENV)) == env)
        return self._then("search", lambda d: d.where(P.all_of(tests)), note=Note(filters=tuple(tests)))

    def where(self, predicate: Column) -> Search:
        return self._then("where", lambda d: d.where(predicate), note=Note(filters=(predicate,)))

    def fields(self, *names: str) -> Search:
        return self._then("fields", lambda d: d.select(*names), note=Note(only=names))

    table = fields

    def rename(self, **names: str) -> Search:
        """new=old."""
        return self._then("rename", lambda d: d.withColumnsRenamed({old: new for new, old in names.items()}), note=Note(renamed=tuple(names.items())))

    def eval(self, **columns: Column) -> Search:
        return self._then("eval", lambda d: d.withColumns(columns), note=Note(made=tuple(columns.items())))

    def rex(self, column: str, pattern: str) -> Search:
        """Named groups become columns; no match is null."""
        import re

        java = P.java_pattern(pattern)
        names = re.findall(r"\(\?<([A-Za-z]\w*)>", java)
        order = [m[1] for m in re.finditer(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<([A-Za-z]\w*)>", java)]
        found = {n: F.when(P.regex(F.col(column), pattern), F.regexp_extract(column, java, order.index(n) + 1)) for n in names}
        return self._then("rex", lambda d: d.withColumns(found), note=Note(made=tuple((n, column) for n in found)))

    def exclude(self, column: str, networks: list[str], hosts: list[str] = (), host_column: str = "host", mode: str = "prefix") -> Search:
        """Without the given addresses, networks and hosts; null addresses stay."""
        inside = P.any_of([P.in_network(F.col(column), n, mode) for n in networks])
        test = ~F.coalesce(inside, F.lit(False))
        if hosts:
            test &= ~F.coalesce(F.col(host_column).isin(list(hosts)), F.lit(False))
        return self._then("exclude", lambda d: d.where(test), note=Note(filters=(column, *([host_column] if hosts else []))))

    # aggregation, ordering, shaping
    def stats(self, *aggs, by: list[str] = ()) -> Search:
        return self._then("stats", lambda d: d.groupBy(*by).agg(*_aggs(aggs)), (), _grouped(aggs, by))

    def timechart(self, span: int, *aggs, by: list[str] = ()) -> Search:
        return self._then("timechart", lambda d: d.groupBy(bucket(F.col("ts"), span).alias("bucket"), *by).agg(*_aggs(aggs)), (), _grouped(aggs, by, ("bucket", "ts")))

    def eventstats(self, *aggs, by: list[str] = ()) -> Search:
        """Aggregates joined to each row. Groups are aggregated first, so a hot group never sits in one task."""

        def step(d: DataFrame) -> DataFrame:
            totals = d.groupBy(*by).agg(*_aggs(aggs))
            if not by:
                return d.crossJoin(totals)  # a single row
            right = totals.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[c for c in totals.columns if c not in by])
            on = P.all_of([d[k].eqNullSafe(right[f"_k_{k}"]) for k in by])
            return d.join(right, on, "left").drop(*[f"_k_{k}" for k in by])

        return self._then("eventstats", step, note=Note(made=_aggregated(aggs)))

    def top(self, column: str, n: int = 10, *, rare: bool = False) -> Search:
        """Value, count and percent of the most (or least) frequent values; ties by value."""

        def step(d: DataFrame) -> DataFrame:
            counts = d.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
            total = counts.agg(F.sum("count").alias("_total"))
            first = F.asc("count") if rare else F.desc("count")
            best = counts.orderBy(first, column).limit(n)
            return best.crossJoin(total).select(column, "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"))  # a single row

        return self._then("rare" if rare else "top", step, (), Note(only=(column,)))

    def rare(self, column: str, n: int = 10) -> Search:
        return self.top(column, n, rare=True)

    def rate(self, span: int, by: list[str] = ()) -> Search:
        """Events a second in each bucket."""
        return self._then("rate", lambda d: d.groupBy(bucket(F.col("ts"), span).alias("bucket"), *by).agg((F.count("*") / F.lit(span)).alias("rate")), (), Note(made=(("bucket", "ts"),), only=("bucket", *by)))

    def dedup(self, *keys: str) -> Search:
        """First row of each key in the current order, then by id."""
        order = [*self.order, F.col("id")] if self.order else [F.col("id")]

        def step(d: DataFrame) -> DataFrame:
            n = unused(d, "_n")
            first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            return d.withColumn(n, first).where(F.col(n) == 1).drop(n)  # Spark keeps one row a key in each task before it shuffles

        return self._then("dedup", step)

    def sort(self, *keys: str) -> Search:
        """``-key`` is descending."""
        order = tuple(F.desc(k[1:]) if k[0] == "-" else F.asc(k.lstrip("+")) for k in keys)
        return self._then("sort", lambda d: d.orderBy(*order), order)

    def head(self, n: int) -> Search:
        return self._then("head", lambda d: d.limit(n))

    limit = head

    def mvexpand(self, column: str, sep: str = ",") -> Search:
        """One row for each value of a JSON array or separated list; a null stays a row."""
        c = F.col(column)
        listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.transform(F.split(c, sep), lambda x: F.trim(x)))
        return self._then("mvexpand", lambda d: d.withColumn(column, F.explode_outer(listed)))

    # joins
    def join(self, sub: Search | DataFrame, on: str | list[str], how: str = "inner") -> Search:
        right = sub.df if isinstance(sub, Search) else sub
        keys = (on,) if isinstance(on, str) else tuple(on)
        return self._then("join", lambda d: d.join(right, on, how), note=Note(filters=keys, sub=sub, again=lambda d, r: d.join(r, on, how)))

    def append(self, sub: Search | DataFrame) -> Search:
        right = sub.df if isinstance(sub, Search) else sub
        both = lambda d, r: d.unionByName(r, allowMissingColumns=True)
        return self._then("append", lambda d: both(d, right), note=Note(sub=sub, again=both))

    def lookup(self, table: DataFrame, key: str, output: list[str] | None = None) -> Search:
        """Columns of a lookup table (key, val as JSON); without ``output`` the raw value."""

        def step(d: DataFrame) -> DataFrame:
            made = [F.get_json_object("val", f"$['{o}']").alias(o) for o in output] if output else [F.col("val").alias("lookup")]
            right = table.select(F.col("key").alias("_lookup_key"), *made)
            return d.join(right, d[key] == right["_lookup_key"], "left").drop("_lookup_key")

        return self._then("lookup", step, note=Note(made=tuple((o, key) for o in output or ["lookup"])))

    def auto_lookup(self, specs: list[tuple[DataFrame, str, list[str]]]) -> Search:
        s = self
        for table, key, output in specs:
            s = s.lookup(table, key, output)
        return s

    def keyset_page(self, n: int, cursor: tuple[int, int] | None = None) -> Search:
        """Newest first by (ts, id), strictly after the cursor; one row more than ``n`` tells if there is more."""

        def step(d: DataFrame) -> DataFrame:
            if cursor:
                d = d.where((F.col("ts") < cursor[0]) | ((F.col("ts") == cursor[0]) & (F.col("id") < cursor[1])))
            return d.orderBy(F.desc("ts"), F.desc("id")).limit(n + 1)

        return self._then("page", step, (F.desc("ts"), F.desc("id")))

    def offset_page(self, n: int, offset: int) -> Search:
        return self._then("page", lambda d: d.orderBy(*(self.order or (F.desc("ts"), F.desc("id")))).offset(offset).limit(n))

    def count_total(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("total"))


def pages(s: Search, n: int):
    """All pages of a search: (rows, cursor of the next page or None)."""
    cursor = None
    while True:
        rows = s.keyset_page(n, cursor).df.collect()  # n + 1 rows
        more, rows = len(rows) > n, rows[:n]
        cursor = (rows[-1]["ts"], rows[-1]["id"]) if more else None
        yield rows, cursor
        if not more:
            return


def metric(df: DataFrame, name: str, by: list[str] = (), start: int = 0, end: int = 0) -> DataFrame:
    """Samples of a metric; declared labels become columns."""
    tests = [F.col("name") == name] + ([F.col("ts") >= start] if start else []) + ([F.col("ts") <= end] if end else [])
    out = df.where(P.all_of(tests))
    if by:
        out = out.withColumns({k: F.from_json("labels", "map<string,string>")[k] for k in by})
    return out


def _bar_token(token: str, values: bool) -> Column:
    if token == "*":
        return F.lit(True)
    if token.startswith("~"):
        return P.regex(F.col("message"), token[1:])
    for op, test in ((">=", P.ge), ("<=", P.le), ("!=", P.ne), (">", P.gt), ("<", P.lt), ("=", P.eq), (":", P.eq)):
        key, found, value = token.partition(op)
        if found and key.isidentifier():
            name = BAR_ALIASES.get(key, key)
            if name == "severity":
                v = int(SEVERITY_NAMES.get(value.lower(), value))
                return test(F.col(name), v)
            c = F.col(name) if name in ("source", "category", "host", "src_ip", "dst_ip", "url", "message", "ts", "id", "action", "env_id") else F.get_json_object("fields", f"$['{name}']")
            return test(c, float(value)) if test in (P.ge, P.le, P.gt, P.lt) else test(c, value)
    word = token.lower()
    # most messages don't hold the word at all: they needn't be split
    hit = F.lower("message").contains(word) & F.array_contains(F.split(F.lower("message"), r"\W+"), word)
    if values:
        bag = F.map_values(F.from_json("fields", "map<string,string>"))
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.exists(bag, lambda v: F.array_contains(F.split(F.lower(v), r"\W+"), word)), F.lit(False))
    return hit


def search_bar(df: DataFrame, text: str, limit: int = 100, values: bool = False) -> DataFrame:
    """Words and ``field=value`` filters, all of which must hold; newest first."""
    return df.where(P.all_of([_bar_token(t, values) for t in text.split()])).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


# set operations and joins between tables
def anti_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_anti")


def semi_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_semi")


def uncased(alerts: DataFrame, items: DataFrame) -> DataFrame:
    """Alerts that no case item (ref ``alert:<id>``) refers to."""
    ids = items.where(F.col("ref").startswith("alert:")).select(F.substring_index("ref", ":", -1).try_cast("long").alias("id"))
    return alerts.join(ids, "id", "left_anti")


def in_ranges(df: DataFrame, ranges: DataFrame, test: Column, keep: bool = True) -> DataFrame:
    """Rows for which some range satisfies ``test`` (or none, with ``keep=False``). Ranges are a small table."""
    return df.join(ranges, test, "left_semi" if keep else "left_anti")


def union_hot_cold(hot: DataFrame, cold: DataFrame, boundary: int) -> DataFrame:
    """Cold rows before the boundary and hot rows from it on: disjoint by construction."""
    return cold.where(F.col("ts") < boundary).unionByName(hot.where(F.col("ts") >= boundary), allowMissingColumns=True)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
