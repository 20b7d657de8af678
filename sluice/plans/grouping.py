"""Aggregation: finding aggregates in expressions and computing them by group.

A select after a group by is lowered in two steps: every aggregate inside its
expressions becomes a hidden column of one groupBy, then the expressions
themselves, windows included, are plain columns over its result.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import FlowError
from sluice.functions import library as L
from sluice.operators import global_window, quantile
from sluice.operators.overlap_totals import totals
from sluice.plans import ast as A
from sluice.plans.scope import Group, Named, Scope, fresh_name
from sluice.plans.show import show_expr

if TYPE_CHECKING:
    from sluice.plans.lower import Lowering
    from sluice.plans.lower_expr import Expressions


def is_aggregate(e: A.Expr, scope: Scope, plan: Lowering) -> bool:
    """Whether the expression itself is an aggregate of the scope's rows."""
    if isinstance(e, A.Call):
        return e.name.lower() in L.AGGREGATES and plan.env.function(e.name) is None
    if isinstance(e, A.Dot) and e.name in L.AGGREGATE_METHODS:
        if isinstance(e.base, A.Sub):
            return False
        if e.args is None and isinstance(e.base, A.Col) and scope.has_qualifier(e.base.name) and scope.find(e.name, e.base.name):
            return False
        return plan.env.method(None, e.name) is None
    return False


def has_aggregate(e: Any, scope: Scope, plan: Lowering) -> bool:
    """Whether aggregates stand in it, outside subqueries and not as window functions."""
    if isinstance(e, (A.Sub, A.Exists, A.Rel)):
        return False
    if isinstance(e, A.Over):
        inside = [x for x in A.children(e.expr)]
        return any(has_aggregate(x, scope, plan) for x in (*inside, *e.partition, *(s.expr for s in e.order)))
    if isinstance(e, A.Expr) and is_aggregate(e, scope, plan):
        return True
    return any(has_aggregate(x, scope, plan) for x in A.children(e))


def expanded(plan: Lowering, e: Any) -> Any:
    """User functions replaced by their bodies, so that aggregates inside them are seen."""

    def change(x: A.Expr) -> A.Expr | None:
        if isinstance(x, A.Call) and (f := plan.env.function(x.name)) is not None and f.body is not None:
            return expanded(plan, plan.env.expand(f, x.args, None))
        return None

    return A.rewrite(e, change)


@dataclass
class Extractor:
    """Replaces aggregates and keys by columns of the grouped result."""

    plan: Lowering
    scope: Scope
    group: Group

    def __post_init__(self) -> None:
        self.hidden: dict[A.Expr, str] = {}

    def __call__(self, e: Any) -> Any:
        if isinstance(e, (A.Rel, A.Exists)) or (isinstance(e, A.Sub)):
            return e
        if isinstance(e, A.Expr):
            for i, (name, expr, column) in enumerate(self.group.keys):
                if e == expr or (isinstance(e, A.Col) and e.name in (name, f"_{i + 1}")):
                    return A.Col(column.internal)
            if isinstance(e, A.Col) and e.name.startswith("_") and e.name[1:].isdigit() and int(e.name[1:]) > len(self.group.keys):
                raise FlowError(f"{e.name}: there are {len(self.group.keys)} grouping keys")
            if isinstance(e, A.Over):
                return replace(e, expr=self.inside(e.expr), partition=tuple(map(self, e.partition)), order=tuple(replace(s, expr=self(s.expr)) for s in e.order))
            if is_aggregate(e, self.scope, self.plan):
                return A.Col(self.hidden.setdefault(e, f"_agg{len(self.hidden)}"))
        return self.inside(e)

    def inside(self, e: Any) -> Any:
        if isinstance(e, tuple):
            return tuple(self(x) for x in e)
        if is_dataclass(e) and not isinstance(e, A.Rel):
            return type(e)(**{f.name: self(v) if isinstance(v := getattr(e, f.name), tuple) or is_dataclass(v) else v for f in fields(e)})
        return e


def grouped(plan: Lowering, scope: Scope, items: list[A.Item], keys_first: bool, outer: tuple[Scope, ...]) -> Scope:
    """The pending group by of ``scope`` with output ``items``; ``keys_first`` puts the keys before them."""
    group = scope.group or Group(())
    plain = replace(scope, group=None)
    take = Extractor(plan, plain, group)
    filters = [take(f) for f in group.filters]
    aliases: dict[str, A.Expr] = {}
    wanted: list[tuple[A.Item, A.Expr]] = []
    from sluice.plans.lower_expr import substitute

    for item in items:
        if isinstance(item.expr, A.Star):
            wanted += [(A.Item(A.Col(name), name), A.Col(column.internal)) for name, _, column in group.keys]
            continue
        e = take(substitute(item.expr, aliases, scope))
        wanted.append((item, e))
        if item.name:
            aliases[item.name] = item.expr
    lower = plan.expressions(plain, outer)
    keys = [column for _, _, column in group.keys]
    if outer and take.hidden and not keys and not filters and not any(isinstance(x, (A.Over, A.Sub, A.Exists, A.Lambda)) for _, e in wanted for x in A.walk(e)):
        # One aggregation and nothing above it: only so does Catalyst turn an equality with the relation around into
        # a grouping.  Otherwise it joins with all values of that relation, without its filters (a product of tables).
        bound = {name: lower(e) for e, name in take.hidden.items()}
        value = plan.expressions(Scope(plain.df, ()), outer, bound)
        return replace(plain.project([(item.name or show_expr(item.expr), value(e), frozenset()) for item, e in wanted]), exact=True)
    key_columns = [c.column for c in keys]
    df = plain.df
    apart = {} if outer or group.sets or df.isStreaming or global_window.small(df) else {name: found for e, name in take.hidden.items() if (found := lower.by_values(e)) is not None}
    finer = plan_lattice(lower, take.hidden, keys, df) if group.sets and keys and not outer and not df.isStreaming else None
    if finer is not None:
        df, aggregates = finer
    else:
        aggregates = [lower(e).alias(name) for e, name in take.hidden.items() if name not in apart]
    made = overlap_totals(lower, plain, take.hidden, keys) if keys and not group.sets and not outer else None
    dealt = None
    if not keys or made is not None:
        pass
    elif group.sets == "rollup":
        dealt = df.rollup(*key_columns)
    elif group.sets == "cube":
        dealt = df.cube(*key_columns)
    elif group.sets:
        dealt = df.groupingSets([[key_columns[i] for i in s] for s in group.sets], *key_columns)
    else:
        dealt = df.groupBy(*key_columns)
    if made is not None:
        out = made
    elif dealt is None and apart:
        out = df.agg(*(aggregates or [F.count(F.lit(1)).alias("_one")]))
    elif dealt is None:  # a select of aggregates stays lazy, also inside a correlated subquery
        out = df.select(*aggregates) if aggregates else df.limit(1).select(F.lit(1).alias("_one"))
    elif aggregates:
        out = dealt.agg(*aggregates)
    else:
        out = dealt.agg(F.first(F.lit(1)).alias("_one")) if group.sets else df.select(*key_columns).distinct()
    out = with_values(out, df, [c.internal for c in keys], apart)
    columns = tuple(Named(c.internal, c.internal) for c in keys) + tuple(Named(n, n) for n in take.hidden.values())
    after = Scope(out, columns)
    for f in filters:
        after = replace(after, df=after.df.where(plan.expressions(after, outer)(f)))
    after, windows = plan.spread_windows(after, [e for _, e in wanted], outer)
    lower = plan.expressions(after, outer, windows=windows)
    shown = [(name, column.column, column.qualifiers) for name, _, column in group.keys] if keys_first else []
    for item, e in wanted:
        name = item.name or next((n for i, (n, _, c) in enumerate(group.keys) if isinstance(item.expr, A.Col) and item.expr.name in (n, f"_{i + 1}")), None) or show_expr(item.expr)
        qualifiers = next((c.qualifiers for _, _, c in group.keys if isinstance(e, A.Col) and e.name == c.internal), frozenset())
        shown.append((name, lower(e), qualifiers))
    return after.project(shown)


def with_values(out: DataFrame, df: DataFrame, keys: list[str], apart: dict[str, tuple[str, A.Expr, Column, float]]) -> DataFrame:
    """The groups with those aggregates that look at a group's values by ranges or counts."""
    quantiles: dict[A.Expr, tuple[Column, dict[str, float]]] = {}
    for name, (kind, e, x, share) in apart.items():
        if kind == "quantile":
            quantiles.setdefault(e, (x, {}))[1][name] = share
        else:
            out = quantile.with_group_values(out, keys, quantile.histogram(df, keys, x, name))
            out = out.withColumn(name, F.coalesce(name, F.create_map().cast(out.schema[name].dataType)))
    for x, wanted in quantiles.values():
        out = quantile.with_group_values(out, keys, quantile.exact(df, keys, x, wanted))
    return out


def overlap_totals(lower: Expressions, scope: Scope, hidden: dict[A.Expr, str], keys: list[Named]) -> DataFrame | None:
    """The groups of a join of overlapping intervals without its pairs: keys of the left side, counts and extremes of the right."""
    o = scope.overlap
    if o is None or o.pairs is not scope.df or not hidden or any(k.internal not in o.left.columns for k in keys):
        return None
    counts: dict[str, Column | None] = {}
    extremes: dict[str, tuple[str, Column]] = {}
    for e, name in hidden.items():
        found = lower.mergeable(e)
        kind = e.name.lower() if found is not None else ""
        if kind not in ("count", "count_star", "min", "max") or len(found[1]) > 1 or (kind in ("min", "max") and not found[1]):
            return None
        if found[1] and not all(scope_column_in(x, scope, o.right) for x in A.walk(e) if x is not e):
            return None
        if kind in ("min", "max"):
            extremes[name] = kind, found[1][0]
        else:
            counts[name] = found[1][0] if found[1] else None
    out = totals(o, [k.internal for k in keys], counts, extremes)
    return out.select(*[k.column for k in keys], *hidden.values())


def scope_column_in(e: A.Expr, scope: Scope, df: DataFrame) -> bool:
    """Whether an expression, if it is a column of the scope, is one of ``df``; subqueries are not."""
    if isinstance(e, (A.Sub, A.Exists, A.Over)):
        return False
    if isinstance(e, A.Dot) and isinstance(e.base, A.Col) and scope.has_qualifier(e.base.name):
        found = scope.find(e.name, e.base.name)
    elif isinstance(e, A.Col) and not scope.has_qualifier(e.name):
        found = scope.find(e.name)
    else:
        return True
    return found is not None and found.internal in df.columns


def plan_lattice(lower: Expressions, hidden: dict[A.Expr, str], keys: list[Named], df: DataFrame) -> tuple[DataFrame, list[Column]] | None:
    """For several grouping sets: the aggregates of the finest set, and those that put its rows together for the others.

    Every input row is aggregated once; only the finest groups are copied for
    each set.  None where an aggregate's parts cannot be put together.
    """
    made: dict[str, global_window.Running] = {}
    kept: dict[str, Column] = {}
    for e, name in hidden.items():
        if isinstance(e, A.Call) and e.name.lower() == "grouping":
            kept[name] = lower(e)
            continue
        found = lower.mergeable(e)
        if found is None:
            return None
        made[name] = found[0](found[1])
    parts = {f"_part_{n}_{i}": p for n, f in made.items() for i, p in enumerate(f.parts)}
    base = df.groupBy(*[c.column for c in keys]).agg(*([p.alias(n) for n, p in parts.items()] or [F.count(F.lit(1)).alias("_one")]))
    kind = {f.name: f.dataType for f in base.schema}
    columns = []
    for _, name in hidden.items():
        if name in kept:
            columns.append(kept[name].alias(name))
        else:
            f = made[name]
            columns.append(f.value(*[global_window.merged(m)(f"_part_{name}_{i}").cast(kind[f"_part_{name}_{i}"]) for i, m in enumerate(f.merge)]).alias(name))
    return base, columns


def key_column(plan: Lowering, scope: Scope, item: A.Item, outer: tuple[Scope, ...]) -> tuple[Scope, tuple[str, A.Expr, Named]]:
    """A grouping key as a column of the scope, added if it is an expression."""
    e = item.expr
    if isinstance(e, A.Lit) and isinstance(e.value, int) and not isinstance(e.value, bool) and 1 <= e.value <= len(scope.columns) and item.name is None:
        c = scope.columns[e.value - 1]
        return scope, (c.name, A.Col(c.name), c)
    if isinstance(e, A.Col) and (c := scope.find(e.name)) is not None:
        return scope, (item.name or c.name, e, c)
    if isinstance(e, A.Dot) and e.args is None and isinstance(e.base, A.Col) and scope.has_qualifier(e.base.name) and (c := scope.find(e.name, e.base.name)):
        return scope, (item.name or c.name, e, c)
    internal = fresh_name("key")
    df = scope.df.select("*", plan.expressions(scope, outer)(e).alias(internal))
    named = Named(item.name or show_expr(e), internal)
    return replace(scope, df=df), (named.name, e, named)


def default_output(scope: Scope, plan: Lowering, outer: tuple[Scope, ...]) -> Scope:
    """A group by that nothing follows: its keys and an arbitrary value of every column."""
    group = scope.group
    assert group is not None
    keys = {c.internal for _, _, c in group.keys}
    items = [A.Item(A.Call("arbitrary", (A.Arg(A.Col(c.internal)),)), f"arbitrary({c.name})") for c in scope.columns if c.internal not in keys]
    by_internal = replace(scope, columns=tuple(Named(c.internal, c.internal, c.qualifiers) for c in scope.columns))
    return grouped(plan, by_internal, items, True, outer)


