"""Relations to DataFrames, one method per operator.

Every operator applies to its child's output.  Only plan building happens
here; nothing runs until the caller acts on the DataFrame, except where an
operator's columns depend on data (pivot without values), its size is a share
of a count (reservoir sample) or ranges are cut by a bounded sample (windows
over one order).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError, FlowNameError
from sluice.functions import semantics as S
from sluice.operators import band, global_window, shape
from sluice.operators.asof import asof_join
from sluice.operators.overlap_totals import Overlap
from sluice.plans import ast as A
from sluice.plans import grouping as G
from sluice.plans.env import Env, bind
from sluice.plans.lower_expr import Expressions, as_kind, constant, literal_kind, split_and, substitute
from sluice.plans.scope import Group, Scope, fresh_name
from sluice.plans.show import show_expr
from sluice.sources import catalog, files

if TYPE_CHECKING:
    from sluice.engine import Engine

Outer = tuple[Scope, ...]


def isolated(scope: Scope, e: object) -> Scope:
    """The scope under names of its own if a subquery in ``e`` may refer to it."""
    return scope.isolated() if any(isinstance(x, (A.Sub, A.Exists)) for x in A.walk(e)) else scope


class Lowering:
    def __init__(self, engine: Engine, env: Env, current: Scope | None = None):
        self.engine = engine
        self.spark = engine.spark
        self.env = env
        self.current = current

    def expressions(self, scope: Scope, outer: Outer = (), bound: dict[str, Column] | None = None, windows: dict[A.Expr, str] | None = None) -> Expressions:
        return Expressions(self, scope, outer, bound, windows)

    def row_types(self, scope: Scope) -> list[str]:
        names = {q for c in scope.columns for q in c.qualifiers}
        return [t for n in sorted(names) if (t := self.env.row_type(n))]

    def within(self, env: Env) -> Lowering:
        return Lowering(self.engine, env, self.current)

    # ---------------------------------------------------------------- dispatch

    def relation(self, r: A.Rel, outer: Outer = ()) -> Scope:
        """A relation's scope, with no group by pending."""
        out = self.pending(r, outer)
        return G.default_output(out, self, outer) if out.group else out

    def pending(self, r: A.Rel, outer: Outer) -> Scope:
        return getattr(self, f"_{type(r).__name__.lower()}")(r, outer)

    # ----------------------------------------------------------------- sources

    def _nothing(self, r: A.Nothing, outer: Outer) -> Scope:
        return Scope(self.spark.range(1).select(F.lit(1).alias("_one")), ())

    def _current(self, r: A.Current, outer: Outer) -> Scope:
        if self.current is None:
            raise FlowError("no relation to hang on")
        return self.current

    def _table(self, r: A.Table, outer: Outer) -> Scope:
        found = self.env.table(r.name)
        if found is not None:
            return found
        if self.env.model(r.name) is not None:
            return self._function(A.Function(r.name, ()), outer)
        df = self.engine.source(r.name)
        if df is None:
            raise FlowNameError(f"no table {r.name}")
        return Scope.of(df, r.name.rsplit(".", 1)[-1])

    def _computedtable(self, r: A.ComputedTable, outer: Outer) -> Scope:
        return self._table(A.Table(self.engine.text_value(r.parts, self.env)), outer)

    def _file(self, r: A.File, outer: Outer) -> Scope:
        path = files.located(r.path, self.engine.base_dir)
        if files.kind_of(path) == "wv":
            return Scope.of(self.engine.included(path, self.env))
        if files.kind_of(path) == "sql":
            return Scope.of(self.engine.sql(self.engine.file_text(path)))
        return Scope.of(self.engine.opened(files.read(self.spark, path)))

    def _values(self, r: A.Values, outer: Outer) -> Scope:
        width = {len(row) for row in r.rows}
        if len(width) > 1:
            raise FlowError(f"rows of different widths: {sorted(width)}")
        names = [f"col{i}" for i in range(width.pop() if width else 1)]
        rows = [tuple(self.engine.with_vals(e, self.env) for e in row) for row in r.rows]
        try:
            values = [[constant(e) for e in row] for row in rows]
        except ValueError:
            lower = self.expressions(Scope(self.spark.range(1), ()), outer)
            structs = [F.struct(*[lower(e).alias(n) for e, n in zip(row, names, strict=True)]) for row in rows]
            return Scope.of(self.spark.range(1).select(F.inline(F.array(*structs))))
        kinds = [literal_kind([row[i] for row in values]) for i in range(len(names))]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
        return Scope.of(self.spark.createDataFrame([tuple(as_kind(v, k) for v, k in zip(row, kinds, strict=True)) for row in values], schema))

    def _rawquery(self, r: A.RawQuery, outer: Outer) -> Scope:
        return Scope.of(self.engine.sql(self.engine.text_value(r.parts, self.env, as_sql=True)))

    def _rawjson(self, r: A.RawJson, outer: Outer) -> Scope:
        found = json.loads(r.text)
        rows = found if isinstance(found, list) else [found]
        names = list(dict.fromkeys(k for row in rows for k in row))
        kinds = [literal_kind([row.get(n) for row in rows]) for n in names]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
        return Scope.of(self.spark.createDataFrame([tuple(as_kind(row.get(n), k) for n, k in zip(names, kinds, strict=True)) for row in rows], schema))

    def _function(self, r: A.Function, outer: Outer) -> Scope:
        model = self.env.model(r.name)
        if model is not None:
            env = self.env.child()
            env.vals.update({k: self.engine.with_vals(v, self.env) for k, v in bind(model.name, model.params, r.args).items()})
            out = self.within(env).relation(model.relation)
            if model.type:
                self.env.row_types.setdefault(model.name, model.type)
            return out.aliased(model.name.rsplit(".", 1)[-1])
        if r.name in ("wv_tables", "wv_schemas"):
            return Scope.of(getattr(catalog, r.name)(self.spark), r.name)
        lower = self.expressions(Scope(self.spark.range(1), ()), outer)
        if r.name == "unnest":
            return Scope.of(self.spark.range(1).select(F.explode(lower(r.args[0].value)).alias("unnest")), "unnest")
        if r.name == "range" or r.name == "generate_series":
            n = [constant(a.value) for a in r.args]
            start, end = (0, n[0]) if len(n) == 1 else n[:2]
            return Scope.of(self.spark.range(start, end + (r.name == "generate_series"), *n[2:3]).toDF(r.name), r.name)
        if r.name in ("duckdb_functions", "spark_functions"):
            rows = [(f.name,) for f in self.spark.catalog.listFunctions()]
            return Scope.of(self.spark.createDataFrame(rows, "function_name string"), r.name)
        if r.name == "parquet_metadata":
            df = self.spark.read.parquet(files.located(constant(r.args[0].value), self.engine.base_dir))
            rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
            return Scope.of(self.spark.createDataFrame(rows, "path_in_schema string, type string"), r.name)
        raise FlowNameError(f"no model or table function {r.name}")

    def _subscribe(self, r: A.Subscribe, outer: Outer) -> Scope:
        from sluice.streaming.subscribe import subscribe

        options = {a.name: constant(a.value) for a in r.options}
        if "checkpoint" in options and "target" in options:
            inner = self.engine.on_streams()
            return Scope.of(subscribe(inner.lowering(self.env).relation(r.model).shown(), **options))
        return Scope.of(subscribe(self.relation(r.model, outer).shown(), **options))

    def _alias(self, r: A.Alias, outer: Outer) -> Scope:
        if isinstance(r.child, A.Function) and r.child.name == "unnest" and r.columns:
            return self.relation(r.child, outer).aliased(r.name, [n for n, _ in r.columns])
        scope = self.relation(r.child, outer)
        names = [n for n, _ in r.columns]
        if isinstance(r.child, A.Table) and (kind := self.env.row_type(r.child.name)):
            self.env.row_types.setdefault(r.name, kind)
        out = scope.aliased(r.name, names)
        typed = [(c, t) for c, (_, t) in zip(out.columns, r.columns, strict=False) if t]
        if not typed:
            return out
        to = {c.internal: t for c, t in typed}
        lower = self.expressions(out, outer)
        columns = [S.cast(c.column, lower.type_of(c.column), to[c.internal]).alias(c.internal) if c.internal in to else c.column for c in out.columns]
        return replace(out, df=out.df.select(*columns))

    def _implicit(self, r: A.Implicit, outer: Outer) -> Scope:
        """A comma list: products that the filters after it turn into equi-joins."""
        out = self.relation(r.items[0], outer)
        for item in r.items[1:]:
            right = out.beside(self.relation(item, outer))
            out = Scope(out.df.crossJoin(right.df), (*out.columns, *right.columns))
        return out

    def _with(self, r: A.With, outer: Outer) -> Scope:
        env = self.env.child()
        inside = self.within(env)
        for name, columns, relation in r.definitions:
            env.tables[name] = inside.relation(relation, outer).aliased(name, columns)
        return inside.pending(r.body, outer)

    # ------------------------------------------------------------------ columns

    def _filter(self, r: A.Filter, outer: Outer) -> Scope:
        scope = self.pending(r.child, outer)
        if scope.group:
            return replace(scope, group=replace(scope.group, filters=(*scope.group.filters, G.expanded(self, r.condition))))
        scope = isolated(scope, r.condition)
        spread, windows = self.hidden_columns(scope, [r.condition], outer)
        df = spread.df.where(self.expressions(spread, outer, windows=windows)(r.condition))
        return replace(scope, df=df.select(*scope.df.columns) if windows else df)

    def spread_windows(self, scope: Scope, exprs: list[A.Expr], outer: Outer) -> tuple[Scope, dict[A.Expr, str]]:
        """The scope with hidden columns for windows that have no partition, and their names."""
        found = dict.fromkeys(x for e in exprs for x in A.walk(e) if isinstance(x, A.Over) and not x.partition)
        found = [x for x in found if not any(isinstance(y, (A.Sub, A.Exists)) or (isinstance(y, A.Over) and y is not x) for y in A.walk(x))]
        if not found or outer or scope.df.isStreaming or global_window.small(scope.df):
            return scope, {}
        lower = self.expressions(scope, outer)
        names: dict[A.Expr, str] = {}
        orders: dict[tuple[A.Sort, ...], dict[str, object]] = {}
        totals: dict[str, Column] = {}
        for x in found:
            name = fresh_name("win")
            if not x.order or (x.frame is not None and x.frame.start is None and x.frame.end is None):
                if (value := lower.plain_aggregate(x.expr)) is not None:
                    totals[name], names[x] = value, name
            elif (f := lower.over_ranges(x)) is not None:
                orders.setdefault(x.order, {})[name] = f
                names[x] = name
        df = scope.df
        for order, functions in orders.items():
            keys = [global_window.Key(lower(s.expr), s.desc, s.nulls_first) for s in order]
            if global_window.supported(df, keys):
                df = global_window.spread(df, keys, functions, base=scope.df)
            else:
                names = {x: n for x, n in names.items() if n not in functions}
        if totals:
            df = global_window.whole(df, totals)
        return replace(scope, df=df), names

    def running_subqueries(self, scope: Scope, exprs: list[A.Expr], outer: Outer) -> tuple[Scope, dict[A.Expr, str]]:
        """The scope with hidden columns for subqueries that aggregate all rows below or above the outer row's value."""
        names: dict[A.Expr, str] = {}
        if outer or scope.df.isStreaming:
            return scope, names
        lower = self.expressions(scope, outer)
        for e in dict.fromkeys(x for e in exprs for x in A.walk(e) if isinstance(x, A.Sub)):
            r = e.relation
            if not isinstance(r, (A.Project, A.Agg)) or len(r.items) != 1 or (isinstance(r, A.Project) and r.distinct):
                continue
            found = lower.correlated(r.child)
            item = G.expanded(self, r.items)[0].expr
            if found is None or found.base.df.isStreaming or any(isinstance(x, (A.Sub, A.Exists, A.Over)) for x in A.walk(item)):
                continue
            take = G.Extractor(self, found.base, Group(()))
            value = take(item)
            inside = self.expressions(found.base)
            calls = {name: inside.mergeable(x) for x, name in take.hidden.items()}
            if not calls or None in calls.values():
                continue
            df = found.base.df
            for c in found.own:
                df = df.where(inside(c))
            hidden = {name: fresh_name("sub") for name in calls}
            pairs = [(inside(a), lower(b)) for a, b in found.pairs]
            functions = {hidden[n]: f for n, (f, _) in calls.items()}
            args = {hidden[n]: a for n, (_, a) in calls.items()}
            out = global_window.aggregates_before(scope.df, df, pairs, inside(found.inner), found.op, lower(found.outer), functions, args)
            names[e] = fresh_name("sub")
            bound = {n: F.col(h) for n, h in hidden.items()}
            column = self.expressions(Scope(out, ()), (), bound)(value)
            scope = replace(scope, df=out.select(*scope.df.columns, column.alias(names[e])))
        return scope, names

    def hidden_columns(self, scope: Scope, exprs: list[A.Expr], outer: Outer) -> tuple[Scope, dict[A.Expr, str]]:
        scope, subs = self.running_subqueries(scope, exprs, outer)
        scope, windows = self.spread_windows(scope, exprs, outer)
        return scope, subs | windows

    def items(self, scope: Scope, items: tuple[A.Item, ...], outer: Outer) -> tuple[Scope, list[tuple[str, object, frozenset[str]]]]:
        """The scope to project from, and (shown name, column, qualifiers) of each output column."""
        out: list[tuple[str, object, frozenset[str]]] = []
        aliases: dict[str, A.Expr] = {}
        written: list[A.Expr] = []
        for item in items:
            e = item.expr if isinstance(item.expr, A.Star) else substitute(item.expr, aliases, scope)
            written.append(e)
            if item.name:
                aliases[item.name] = e
        scope, windows = self.hidden_columns(scope, written, outer)
        lower = self.expressions(scope, outer, windows=windows)
        for item, e in zip(items, written, strict=True):
            if isinstance(e, A.Star):
                own = [c for c in scope.columns if e.qualifier is None or e.qualifier in c.qualifiers]
                if e.qualifier and not own:
                    raise FlowNameError(f"no relation {e.qualifier}")
                out += [(c.name, c.column, c.qualifiers) for c in own]
                continue
            qualifiers: frozenset[str] = frozenset()
            name = item.name
            if isinstance(e, A.Col) and (c := scope.find(e.name)):
                qualifiers, name = (c.qualifiers if item.name is None else frozenset()), item.name or c.name
            elif isinstance(e, A.Dot) and e.args is None and isinstance(e.base, (A.Col, A.Here)) and name is None:
                q = e.base.name if isinstance(e.base, A.Col) else None
                if (q is None or scope.has_qualifier(q)) and (c := scope.find(e.name, q)):
                    qualifiers, name = c.qualifiers, c.name
            out.append((name or show_expr(item.expr), lower(e), qualifiers))
        return scope, out

    def _project(self, r: A.Project, outer: Outer) -> Scope:
        scope = self.pending(r.child, outer)
        r = replace(r, items=G.expanded(self, r.items))
        if scope.group or any(G.has_aggregate(i.expr, scope, self) for i in r.items):
            out = G.grouped(self, scope, list(r.items), False, outer)
            return replace(out, df=out.df.distinct()) if r.distinct else out
        scope = isolated(scope, r.items)
        scope, items = self.items(scope, r.items, outer)
        return scope.project(items, r.distinct)

    def _agg(self, r: A.Agg, outer: Outer) -> Scope:
        return G.grouped(self, self.pending(r.child, outer), list(G.expanded(self, r.items)), True, outer)

    def _count(self, r: A.Count, outer: Outer) -> Scope:
        scope = self.pending(r.child, outer)
        if scope.group:
            scope = G.grouped(self, scope, [], True, outer)
        return Scope.of(scope.df.agg(F.count(F.lit(1)).alias("count")))

    def _named(self, r: A.Named, outer: Outer) -> Scope:
        name = r.name if isinstance(r.name, str) else self.engine.text_value(r.name.parts, self.env)
        scope = self.relation(r.child, outer).aliased(name)
        self.engine.env.tables[name] = scope
        if name.isidentifier():
            scope.shown().createOrReplaceTempView(name)
        return scope

    def _add(self, r: A.Add, outer: Outer) -> Scope:
        scope = isolated(self.relation(r.child, outer), r.items)
        own = [(c.name, c.column, c.qualifiers) for c in scope.columns]
        scope, new = self.items(scope, r.items, outer)
        return scope.project([*new, *own] if r.front else [*own, *new])

    def _transform(self, r: A.Transform, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        scope, items = self.items(scope, r.items, outer)
        new = {name.lower(): (name, c, q) for name, c, q in items}
        out = [new.pop(c.name.lower(), (c.name, c.column, c.qualifiers)) for c in scope.columns]
        return scope.project([*out, *new.values()])

    def _exclude(self, r: A.Exclude, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        gone = {scope.need(n).internal for n in r.names}
        return scope.pick(c for c in scope.columns if c.internal not in gone)

    def _rename(self, r: A.Rename, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        new = {scope.need(old).internal: name for old, name in r.names}
        return replace(scope, columns=tuple(replace(c, name=new.get(c.internal, c.name)) for c in scope.columns))

    def _shift(self, r: A.Shift, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        moved = [scope.need(n) for n in r.names]
        rest = [c for c in scope.columns if c not in moved]
        return scope.pick([*rest, *moved] if r.right else [*moved, *rest])

    def _describe(self, r: A.Describe, outer: Outer) -> Scope:
        df = self.relation(r.child, outer).shown()
        rows = [(f.name, S.flow_type(f.dataType)) for f in df.schema]
        return Scope.of(self.spark.createDataFrame(rows, "column_name string, column_type string"))

    # -------------------------------------------------------------- aggregation

    def _groupby(self, r: A.GroupBy, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        keys = []
        for item in r.keys:
            scope, key = G.key_column(self, scope, item, outer)
            keys.append(key)
        return replace(scope, group=Group(tuple(keys), (), r.sets))

    def _pivot(self, r: A.Pivot, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        on = [(scope.need(n), None if v is None else [constant(e) for e in v]) for n, v in r.on]
        items = r.items or (A.Item(A.Call("count", (A.Arg(A.Star()),)), "count"),)
        lower = self.expressions(scope, outer)
        aggregates = []
        used: set[str] = set()
        for item in items:
            counts = (isinstance(item.expr, A.Call) and item.expr.name.lower() in ("count", "count_if")) or (isinstance(item.expr, A.Dot) and item.expr.name in ("count", "count_if", "count_distinct"))
            aggregates.append((item.name or show_expr(item.expr), lower(item.expr), counts))
            used |= {c.internal for x in A.walk(item.expr) if isinstance(x, A.Col) and (c := scope.find(x.name))}
        if r.group:
            group = []
            for item in r.group:
                scope, key = G.key_column(self, scope, item, outer)
                group.append((key[0], key[2].internal))
        else:
            taken = {c.internal for c, _ in on} | used
            group = [(c.name, c.internal) for c in scope.columns if c.internal not in taken]
        out = shape.pivot(scope.df, [(c.internal, v) for c, v in on], [i for _, i in group], aggregates)
        return Scope.of(out.toDF(*[n for n, _ in group], *out.columns[len(group) :]))

    def _unpivot(self, r: A.Unpivot, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        plain = scope.shown()
        return Scope.of(shape.unpivot(plain, [scope.need(c).name for c in r.columns], r.name, r.value))

    # -------------------------------------------------------------------- joins

    def _join(self, r: A.Join, outer: Outer) -> Scope:
        if isinstance(r.right, A.Alias) and isinstance(r.right.child, A.Function) and r.right.child.name == "unnest" or isinstance(r.right, A.Function) and r.right.name == "unnest":
            return self.unnested(r, outer)
        left = self.relation(r.left, outer)
        right = left.beside(self.relation(r.right, outer))
        both = (*left.columns, *right.columns)
        if r.asof:
            return self.asof(r, left, right, outer)
        if r.using:
            pairs = [(left.need(k), right.need(k)) for k in r.using]
            on = F.lit(True)
            for a, b in pairs:
                on = on & (a.column == b.column)
            df = left.df.join(right.df, on, r.kind)
            keep_right = {b.internal for _, b in pairs}
            items = []
            for c in left.columns:
                mate = next((b for a, b in pairs if a == c), None)
                value = F.coalesce(c.column, mate.column) if mate is not None and r.kind in ("full", "right") else c.column
                items.append((c.name, value, c.qualifiers | (mate.qualifiers if mate is not None else frozenset())))
            items += [(c.name, c.column, c.qualifiers) for c in right.columns if c.internal not in keep_right]
            return Scope(df, both).project(items)
        if r.kind == "cross" or r.on is None:
            if r.kind not in ("cross", "inner"):
                raise FlowError(f"{r.kind} join needs a condition")
            return Scope(left.df.crossJoin(right.df), both)
        condition = self.expressions(Scope(left.df.crossJoin(right.df), both), outer)(r.on)
        overlapping = self.overlapping(r, condition, left, right, outer)
        if overlapping is None:
            return Scope(left.df.join(right.df, condition, r.kind), both)
        return Scope(overlapping[0], both, overlap=overlapping[1])

    def overlapping(self, r: A.Join, condition: Column, left: Scope, right: Scope, outer: Outer) -> tuple[DataFrame, Overlap | None] | None:
        """The join by buckets, if the sides share no equality but two inequalities in opposite directions.

        With it what :func:`totals` needs, if there is at most an ``x != y`` besides.
        """
        if r.kind not in ("inner", "left", "right", "full") or left.df.isStreaming or right.df.isStreaming:
            return None

        def side(e: A.Expr) -> Scope | None:
            found = set()
            for x in A.walk(e):
                if isinstance(x, (A.Sub, A.Exists)):
                    return None
                if isinstance(x, A.Dot) and isinstance(x.base, A.Col) and (left.has_qualifier(x.base.name) or right.has_qualifier(x.base.name)):
                    found.add(left.has_qualifier(x.base.name))
                elif isinstance(x, A.Col) and not left.has_qualifier(x.name) and not right.has_qualifier(x.name):
                    found.add(bool(left.find(x.name)))
            return None if len(found) != 1 else left if found.pop() else right

        least: list[tuple[A.Expr, A.Expr, bool]] = []  # (lower, upper, whether strictly)
        apart: list[A.Expr] = []
        for part in split_and(r.on):
            if isinstance(part, A.Between) and not part.negated:
                least += [(part.low, part.expr, False), (part.expr, part.high, False)]
            elif isinstance(part, A.Bin) and part.op in ("<", "<=", ">", ">="):
                least.append((*((part.left, part.right) if part.op[0] == "<" else (part.right, part.left)), len(part.op) == 1))
            elif isinstance(part, A.Bin) and part.op in ("=", "<=>") and {side(part.left), side(part.right)} == {left, right}:
                return None
            else:
                apart.append(part)
        upward = [(a, b, strict) for a, b, strict in least if side(a) is left and side(b) is right]
        downward = [(a, b, strict) for a, b, strict in least if side(a) is right and side(b) is left]
        own, other = self.expressions(left, outer), self.expressions(right, outer)
        for (a1, b1, up), (b2, a2, down) in ((u, d) for u in upward for d in downward):
            ends = [(own, a1), (own, a2), (other, b2), (other, b1)]
            kinds = [at.type_of(at(e)) for at, e in ends]
            bounds = [band.measured(at(e), kind) for (at, e), kind in zip(ends, kinds, strict=True)]
            alike = len({type(k) for k in kinds if not isinstance(k, T.NumericType)}) <= 1
            if all(x is not None for x in bounds) and alike and (r.kind == "inner" or (band.comparable(left.df) and band.comparable(right.df))):
                def join(a: DataFrame, b: DataFrame, kind: str = "inner", bounds: list[Column] = bounds) -> DataFrame:
                    return band.overlap_join(a, b, (bounds[0], bounds[1]), (bounds[2], bounds[3]), condition, kind)

                pairs = join(left.df, right.df, r.kind)
                unequal = self.unequal(apart, side, left, right, outer) if r.kind == "inner" and len(least) == 2 and len(set(kinds)) == 1 else None
                if unequal is None:
                    return pairs, None
                ends = [at(e) for at, e in ends]
                return pairs, Overlap(pairs, join, left.df, right.df, (ends[0], ends[1]), (ends[2], ends[3]), (up, down), unequal or None)
        return None

    def unequal(self, parts: list[A.Expr], side: Callable[[A.Expr], Scope | None], left: Scope, right: Scope, outer: Outer) -> tuple[Column, ...] | None:
        """The sides of a single ``x != y``, nothing for no condition, None for others."""
        if not parts:
            return ()
        part = parts[0]
        if len(parts) > 1 or not isinstance(part, A.Bin) or part.op not in ("!=", "<>") or {side(part.left), side(part.right)} != {left, right}:
            return None
        x, y = (part.left, part.right) if side(part.left) is left else (part.right, part.left)
        own, other = self.expressions(left, outer), self.expressions(right, outer)
        return (own(x), other(y)) if own.type_of(own(x)) == other.type_of(other(y)) else None

    def asof(self, r: A.Join, left: Scope, right: Scope, outer: Outer) -> Scope:
        """Equal keys and one inequality between the sides, either side written first."""
        if r.on is None or r.kind not in ("inner", "left"):
            raise FlowError("asof join takes inner or left, and a condition")
        flip = {">=": "<=", ">": "<", "<=": ">=", "<": ">", "=": "="}
        on_left, on_right = self.expressions(left, outer), self.expressions(right, outer)

        def side(e: A.Expr) -> str:
            names = [x for x in A.walk(e) if isinstance(x, (A.Col, A.Dot))]
            for x in names:
                if isinstance(x, A.Dot) and isinstance(x.base, A.Col):
                    if left.has_qualifier(x.base.name):
                        return "left"
                    if right.has_qualifier(x.base.name):
                        return "right"
            for x in names:
                if isinstance(x, A.Col):
                    if left.find(x.name):
                        return "left"
                    if right.find(x.name):
                        return "right"
            raise FlowError(f"{show_expr(e)} belongs to neither side")

        keys, nearest = [], None
        for part in split_and(r.on):
            if not isinstance(part, A.Bin) or part.op not in flip:
                raise FlowError(f"asof join cannot use {show_expr(part)}")
            a, b, op = part.left, part.right, part.op
            if side(a) == "right":
                a, b, op = b, a, flip[op]
            if side(b) != "right":
                raise FlowError(f"{show_expr(part)} does not relate the two sides")
            if op == "=":
                keys.append((on_left(a), on_right(b)))
            elif nearest is not None:
                raise FlowError("asof join takes one inequality")
            else:
                nearest = (on_left(a), on_right(b), op)
        if nearest is None:
            raise FlowError("asof join needs an inequality")
        df = asof_join(left.df.select(*[c.column for c in left.columns]), right.df.select(*[c.column for c in right.columns]), keys, *nearest, keep_left=r.kind == "left")
        return Scope(df, (*left.columns, *right.columns))

    def unnested(self, r: A.Join, outer: Outer) -> Scope:
        """``cross join unnest(array) as t(x)``: explode per row."""
        alias = r.right if isinstance(r.right, A.Alias) else None
        call = alias.child if alias else r.right
        names = tuple(n for n, _ in alias.columns) if alias else ()
        arrays = tuple(a.value for a in call.args)
        return self._unnest(A.Unnest(r.left, arrays, names, outer=r.kind == "left", table=alias.name if alias else None), outer)

    def _unnest(self, r: A.Unnest, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        lower = self.expressions(scope, outer)
        arrays = [lower(e) for e in r.arrays]
        names = list(r.names)[: len(arrays)] or (["unnest"] if len(arrays) == 1 else [f"unnest{i}" for i in range(len(arrays))])
        ordinal = r.ordinality or (r.names[len(arrays)] if len(r.names) > len(arrays) else None)
        zipped = F.arrays_zip(*[a.alias(f"e{i}") for i, a in enumerate(arrays)]) if len(arrays) > 1 else F.transform(arrays[0], lambda x: F.struct(x.alias("e0")))
        explode = F.posexplode_outer if r.outer else F.posexplode
        df = scope.df.select("*", explode(zipped).alias("_pos", "_el"))
        q = frozenset([r.table]) if r.table else frozenset()
        fields = df.schema["_el"].dataType.names
        items = [(c.name, c.column, c.qualifiers) for c in scope.columns]
        items += [(n, F.col("_el").getField(f), q) for n, f in zip(names, fields, strict=True)]
        if ordinal:
            items.append((ordinal, (F.col("_pos") + 1).cast("bigint"), q))
        return Scope(df, scope.columns).project(items)

    # -------------------------------------------------------- sort, limit, sets

    def _orderby(self, r: A.OrderBy, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        lower = self.expressions(scope, outer)
        keys = []
        for s in r.keys:
            e = s.expr
            if isinstance(e, A.Lit) and isinstance(e.value, int) and not isinstance(e.value, bool):
                if not 1 <= e.value <= len(scope.columns):
                    raise FlowError(f"order by {e.value}: there are {len(scope.columns)} columns")
                c = scope.columns[e.value - 1].column
            else:
                named = next((x for x in scope.columns if x.name == show_expr(e)), None) if not isinstance(e, A.Col) else None
                c = named.column if named else lower(e)
            keys.append(S.sort_key(c, s.desc, s.nulls_first))
        return replace(scope, df=scope.df.orderBy(*keys))

    def _limit(self, r: A.Limit, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        return replace(scope, df=scope.df.limit(r.n))

    def _offset(self, r: A.Offset, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        return replace(scope, df=scope.df.offset(r.n))

    def _hint(self, r: A.Hint, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        lower = self.expressions(scope, outer)
        columns = [lower(s.expr) for s in r.keys]
        sorts = [S.sort_key(c, s.desc, s.nulls_first) for c, s in zip(columns, r.keys, strict=True)]
        df = scope.df
        if r.kind in ("cluster", "distribute"):
            df = df.repartition(*columns)
        if r.kind in ("cluster", "sort"):
            df = df.sortWithinPartitions(*sorts)
        return replace(scope, df=df)

    def _setop(self, r: A.SetOp, outer: Outer) -> Scope:
        left, right = self.relation(r.left, outer), self.relation(r.right, outer)
        if len(left.columns) != len(right.columns):
            raise FlowError(f"{r.kind}: {len(left.columns)} columns and {len(right.columns)}")
        a = left.pick(left.columns)
        b = right.df.select(*[c.column for c in right.columns])
        operation = {
            ("union", True): lambda: a.df.union(b), ("union", False): lambda: a.df.union(b).distinct(), ("intersect", False): lambda: a.df.intersect(b),
            ("intersect", True): lambda: a.df.intersectAll(b), ("except", False): lambda: a.df.subtract(b), ("except", True): lambda: a.df.exceptAll(b),
        }[r.kind, r.all]
        return replace(a, df=operation())

    def _dedup(self, r: A.Dedup, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        scope = scope.pick(scope.columns)
        return replace(scope, df=scope.df.distinct())

    def _sample(self, r: A.Sample, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        return replace(scope, df=shape.sample(scope.df, r.method or "reservoir", r.size, r.percent))

    # ------------------------------------------------------------ side branches

    def _test(self, r: A.Test, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        self.engine.check(r.check, scope)
        return scope

    def _debug(self, r: A.Debug, outer: Outer) -> Scope:
        scope = self.relation(r.child, outer)
        self.engine.debug(r.branch, scope, self.env)
        return scope

    def _show(self, r: A.Show, outer: Outer) -> Scope:
        env: Env | None = self.env
        models: list[tuple[str, str, str]] = []
        tables: list[str] = []
        while env is not None:
            models += [(m.name, ", ".join(p.name + (f":{p.type}" if p.type else "") for p in m.params), self.engine.package) for m in env.models.values()]
            tables += env.tables
            env = env.parent
        return Scope.of(catalog.show(self.spark, r.what, r.where, models, [*tables, *self.engine.known_sources()]))

