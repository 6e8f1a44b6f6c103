"""The semantic layer: aliases, calculated fields, event types, tags, macros, data models, pivots, datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secspark.functions import predicates as P
from secspark.operators.search import Search


def field_alias(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """canonical <- source; a value that is there already stays."""
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.withColumns({k: F.coalesce(own(k), F.col(v)) for k, v in aliases.items()})


def calculated_fields(df: DataFrame, fields: list[tuple[str, Callable[[], Column]]]) -> DataFrame:
    """In order: a later field may use an earlier one."""
    for name, make in fields:
        df = df.withColumn(name, make())
    return df


def event_types(df: DataFrame, types: dict[str, Callable[[], Column]]) -> DataFrame:
    """event_types: names of the predicates that hold."""
    return df.withColumn("event_types", F.filter(F.array(*[F.when(F.coalesce(p(), F.lit(False)), F.lit(k)) for k, p in types.items()]), lambda x: x.isNotNull()))


def tag(pairs: list[tuple[str, object]]) -> Column:
    """True if any field=value pair holds."""
    return P.any_of([F.coalesce(P.eq(F.col(f), v), F.lit(False)) for f, v in pairs])


class Macros:
    """Named, parametrised steps of a search."""

    def __init__(self):
        self._steps: dict[str, tuple[tuple[str, ...], Callable]] = {}

    def define(self, name: str, *parameters: str):
        def wrap(f):
            self._steps[name] = (parameters, f)
            return f

        return wrap

    def apply(self, search: Search, name: str, **arguments) -> Search:
        parameters, f = self._steps[name]
        if set(parameters) != set(arguments):
            raise TypeError(f"{name} takes {', '.join(parameters) or 'nothing'}")
        return f(search, **arguments)


@dataclass(frozen=True)
class DataModel:
    """An object with its own constraint and declared fields; a child adds to its parent's."""

    name: str
    constraint: Callable[[], Column]
    fields: dict[str, str] = attr(default_factory=dict)
    parent: DataModel | None = None
    TYPES = {"string": "string", "number": "double", "ipv4": "string", "timestamp": "long", "boolean": "boolean"}

    def all_fields(self) -> dict[str, str]:
        return {**(self.parent.all_fields() if self.parent else {}), **self.fields}

    def rows(self, df: DataFrame) -> DataFrame:
        base = self.parent.filtered(df) if self.parent else df
        unknown = {t for t in self.all_fields().values()} - set(self.TYPES)
        if unknown:
            raise ValueError(f"field types {sorted(unknown)}")
        value = lambda k: F.col(k) if k in df.columns else F.get_json_object("fields", f"$['{k}']")
        return base.where(self.constraint()).select(*[value(k).try_cast(self.TYPES[t]).alias(k) for k, t in self.all_fields().items()])

    def filtered(self, df: DataFrame) -> DataFrame:
        return (self.parent.filtered(df) if self.parent else df).where(self.constraint())


def pivot(df: DataFrame, model: DataModel, split_by: list[str], stats: list, filters: list[tuple[str, str, object]] = (), span: int = 0, limit: int = 0) -> DataFrame:
    """Filters, then stats or a time chart by declared fields only; largest first where limited."""
    allowed = set(model.all_fields())
    used = {*split_by, *(f for f, _, _ in filters), *(s[1] for s in stats if not isinstance(s, str))}
    if not used <= allowed:
        raise ValueError(f"not in {model.name}: {', '.join(sorted(used - allowed))}")
    tests = [{"=": P.eq, "!=": P.ne, ">": P.gt, ">=": P.ge, "<": P.lt, "<=": P.le}[op](F.col(f), v) for f, op, v in filters]
    s = Search(model.rows(df)).search(*tests)
    s = s.timechart(span, *stats, by=split_by) if span else s.stats(*stats, by=split_by)
    if limit:
        first = stats[0] if isinstance(stats[0], str) else stats[0][0]
        s = s.sort(f"-{first}", *split_by).head(limit)
    return s.df


def register_dataset(df: DataFrame, name: str) -> DataFrame:
    """A saved search or pivot under a name that SQL can use."""
    df.createOrReplaceTempView(name)
    return df
