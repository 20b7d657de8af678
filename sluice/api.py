"""A fluent front door that builds the same plans as the parser.

>>> flow(engine, "lineitem").where("l_quantity > 10").group_by("l_returnflag").agg("_.count as n").df()

Operators take flow text for their expressions; every call returns a new
object, and nothing is lowered before ``df``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from sluice.engine import Engine
from sluice.errors import FlowSyntaxError
from sluice.plans import ast as A
from sluice.plans.parser import Parser, parse_expr, parse_query


def _items(texts: tuple[str, ...]) -> tuple[A.Item, ...]:
    p = Parser(", ".join(texts))
    out = p.items()
    if p.token.kind != "end":
        raise p.fail("expected the end of the list")
    return out


def _sorts(texts: tuple[str, ...]) -> tuple[A.Sort, ...]:
    p = Parser(", ".join(texts))
    out = p.sort_keys()
    if p.token.kind != "end":
        raise p.fail("expected the end of the list")
    return out


@dataclass(frozen=True)
class Flow:
    engine: Engine
    plan: A.Rel

    def _next(self, plan: A.Rel) -> Flow:
        return replace(self, plan=plan)

    def _relation(self, other: Flow | str) -> A.Rel:
        return other.plan if isinstance(other, Flow) else parse_query(f"from {other}")

    def alias(self, name: str, *columns: str) -> Flow:
        return self._next(A.Alias(self.plan, name, tuple((c, None) for c in columns)))

    def where(self, condition: str) -> Flow:
        return self._next(A.Filter(self.plan, parse_expr(condition)))

    def select(self, *items: str, distinct: bool = False) -> Flow:
        return self._next(A.Project(self.plan, _items(items), distinct))

    def add(self, *items: str) -> Flow:
        return self._next(A.Add(self.plan, _items(items)))

    def prepend(self, *items: str) -> Flow:
        return self._next(A.Add(self.plan, _items(items), front=True))

    def transform(self, *items: str) -> Flow:
        return self._next(A.Transform(self.plan, _items(items)))

    def exclude(self, *names: str) -> Flow:
        return self._next(A.Exclude(self.plan, names))

    def rename(self, **names: str) -> Flow:
        return self._next(A.Rename(self.plan, tuple(names.items())))

    def shift(self, *names: str, right: bool = False) -> Flow:
        return self._next(A.Shift(self.plan, names, right))

    def group_by(self, *keys: str) -> Flow:
        return self._next(A.GroupBy(self.plan, _items(keys)))

    def rollup(self, *keys: str) -> Flow:
        return self._next(A.GroupBy(self.plan, _items(keys), "rollup"))

    def cube(self, *keys: str) -> Flow:
        return self._next(A.GroupBy(self.plan, _items(keys), "cube"))

    def grouping_sets(self, keys: list[str], sets: list[list[int]]) -> Flow:
        """``sets`` hold the numbers of the keys, from 0."""
        return self._next(A.GroupBy(self.plan, _items(tuple(keys)), tuple(map(tuple, sets))))

    def agg(self, *items: str) -> Flow:
        return self._next(A.Agg(self.plan, _items(items)))

    def count(self) -> Flow:
        return self._next(A.Count(self.plan))

    def order_by(self, *keys: str) -> Flow:
        return self._next(A.OrderBy(self.plan, _sorts(keys)))

    def limit(self, n: int) -> Flow:
        return self._next(A.Limit(self.plan, n))

    def offset(self, n: int) -> Flow:
        return self._next(A.Offset(self.plan, n))

    def dedup(self) -> Flow:
        return self._next(A.Dedup(self.plan))

    def sample(self, size: float, percent: bool = False, method: str = "reservoir") -> Flow:
        return self._next(A.Sample(self.plan, method, size, percent))

    def join(self, other: Flow | str, on: str | None = None, kind: str = "inner", using: tuple[str, ...] = (), asof: bool = False) -> Flow:
        return self._next(A.Join(self.plan, self._relation(other), kind, parse_expr(on) if on else None, tuple(using), asof))

    def concat(self, other: Flow | str) -> Flow:
        return self._next(A.SetOp("union", self.plan, self._relation(other), all=True))

    def union(self, other: Flow | str) -> Flow:
        return self._next(A.SetOp("union", self.plan, self._relation(other)))

    def intersect(self, other: Flow | str, all: bool = False) -> Flow:
        return self._next(A.SetOp("intersect", self.plan, self._relation(other), all))

    def except_(self, other: Flow | str, all: bool = False) -> Flow:
        return self._next(A.SetOp("except", self.plan, self._relation(other), all))

    def pivot(self, on: str, values: list | None = None, group_by: tuple[str, ...] = (), agg: tuple[str, ...] = ()) -> Flow:
        chosen = None if values is None else tuple(A.Lit(v) for v in values)
        return self._next(A.Pivot(self.plan, ((on, chosen),), _items(tuple(group_by)) if group_by else (), _items(tuple(agg)) if agg else ()))

    def unpivot(self, columns: list[str], name: str, value: str = "value") -> Flow:
        return self._next(A.Unpivot(self.plan, value, name, tuple(columns)))

    def unnest(self, *arrays: str, names: tuple[str, ...] = (), ordinality: str | None = None, outer: bool = False) -> Flow:
        return self._next(A.Unnest(self.plan, tuple(map(parse_expr, arrays)), tuple(names), ordinality, outer))

    def describe(self) -> Flow:
        return self._next(A.Describe(self.plan))

    def df(self) -> DataFrame:
        return self.engine.lowering().relation(self.plan).shown()

    def save(self, target: str, **options: object) -> None:
        self.engine.execute(A.Save(self.plan, target, "." in target or "/" in target, tuple(options.items())))


def flow(engine: Engine, source: str) -> Flow:
    """A flow that starts at a table, a quoted file, values or any ``from`` text."""
    try:
        return Flow(engine, parse_query(f"from {source}"))
    except FlowSyntaxError:
        return Flow(engine, parse_query(source))
