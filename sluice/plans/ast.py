"""Plan and expression nodes of a flow query.

A query is a chain of relation nodes, each applying to its child's output.
All nodes are immutable and compare by value.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

# ---------------------------------------------------------------- expressions


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Lit(Expr):
    """int, float, Decimal, str, bool or None."""

    value: Any


@dataclass(frozen=True)
class Typed(Expr):
    """A literal written with its type: date'…', '…':interval, interval '1' day."""

    text: str
    type: str


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Star(Expr):
    qualifier: str | None = None


@dataclass(frozen=True)
class Here(Expr):
    """``_``: the current relation."""


@dataclass(frozen=True)
class This(Expr):
    """``this`` inside a method."""


@dataclass(frozen=True)
class Arg:
    value: Expr
    name: str | None = None


@dataclass(frozen=True)
class Sort:
    expr: Expr
    desc: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Arg, ...] = ()
    distinct: bool = False
    order: tuple[Sort, ...] = ()
    where: Expr | None = None
    ignore_nulls: bool = False


@dataclass(frozen=True)
class Dot(Expr):
    """``base.name`` or ``base.name(args)``: qualified column, field or method."""

    base: Expr
    name: str
    args: tuple[Arg, ...] | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str
    expr: Expr


@dataclass(frozen=True)
class Between(Expr):
    expr: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class In(Expr):
    expr: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    expr: Expr
    pattern: Expr
    escape: Expr | None = None
    negated: bool = False
    regex: bool = False


@dataclass(frozen=True)
class Exists(Expr):
    relation: Rel


@dataclass(frozen=True)
class Sub(Expr):
    """A subquery used as a value or as the list of IN."""

    relation: Rel


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    expr: Expr
    type: str
    safe: bool = False


@dataclass(frozen=True)
class Index(Expr):
    expr: Expr
    index: Expr


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class TupleOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class StructOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[Expr, Expr], ...]


@dataclass(frozen=True)
class Lambda(Expr):
    params: tuple[str, ...]
    body: Expr


@dataclass(frozen=True)
class Frame:
    """Window frame; None is unbounded."""

    start: int | None
    end: int | None
    by_range: bool = False


@dataclass(frozen=True)
class Over(Expr):
    expr: Expr
    partition: tuple[Expr, ...] = ()
    order: tuple[Sort, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Text(Expr):
    """s"…${e}…": strings and expressions in turn."""

    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class RawSql(Expr):
    """sql"…${e}…" as an expression."""

    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class Should(Expr):
    """A test's comparison: be, not be, contain, not contain, =, <, …"""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Item:
    """An output column: expression and its name, if given."""

    expr: Expr
    name: str | None = None


# ------------------------------------------------------------------ relations


class Rel:
    """A relation."""


@dataclass(frozen=True)
class Nothing(Rel):
    """One row without columns: ``select`` without ``from``."""


@dataclass(frozen=True)
class Current(Rel):
    """The relation that a debug block hangs on."""


@dataclass(frozen=True)
class Table(Rel):
    name: str


@dataclass(frozen=True)
class ComputedTable(Rel):
    """s`name_${e}`."""

    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class File(Rel):
    path: str


@dataclass(frozen=True)
class Values(Rel):
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class RawQuery(Rel):
    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class RawJson(Rel):
    text: str


@dataclass(frozen=True)
class Function(Rel):
    """A model or table function with arguments."""

    name: str
    args: tuple[Arg, ...]


@dataclass(frozen=True)
class Subscribe(Rel):
    model: Rel
    options: tuple[Arg, ...]


@dataclass(frozen=True)
class Alias(Rel):
    child: Rel
    name: str
    columns: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Implicit(Rel):
    """Comma list of relations."""

    items: tuple[Rel, ...]


@dataclass(frozen=True)
class With(Rel):
    definitions: tuple[tuple[str, tuple[str, ...], Rel], ...]
    body: Rel


@dataclass(frozen=True)
class Filter(Rel):
    child: Rel
    condition: Expr


@dataclass(frozen=True)
class Project(Rel):
    child: Rel
    items: tuple[Item, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Named(Rel):
    """``select as name``."""

    child: Rel
    name: Expr | str


@dataclass(frozen=True)
class Add(Rel):
    child: Rel
    items: tuple[Item, ...]
    front: bool = False


@dataclass(frozen=True)
class Transform(Rel):
    """Replace the named columns in place, append the others."""

    child: Rel
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Exclude(Rel):
    child: Rel
    names: tuple[str, ...]


@dataclass(frozen=True)
class Rename(Rel):
    child: Rel
    names: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Shift(Rel):
    child: Rel
    names: tuple[str, ...]
    right: bool = False


@dataclass(frozen=True)
class GroupBy(Rel):
    child: Rel
    keys: tuple[Item, ...]
    #: None, "rollup", "cube", or a tuple of grouping sets as tuples of key numbers
    sets: Any = None


@dataclass(frozen=True)
class Agg(Rel):
    child: Rel
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Count(Rel):
    child: Rel


@dataclass(frozen=True)
class Pivot(Rel):
    child: Rel
    #: column name and its values, None for all
    on: tuple[tuple[str, tuple[Expr, ...] | None], ...]
    group: tuple[Item, ...] = ()
    items: tuple[Item, ...] = ()


@dataclass(frozen=True)
class Unpivot(Rel):
    child: Rel
    value: str
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Limit(Rel):
    child: Rel
    n: int


@dataclass(frozen=True)
class Offset(Rel):
    child: Rel
    n: int


@dataclass(frozen=True)
class OrderBy(Rel):
    child: Rel
    keys: tuple[Sort, ...]


@dataclass(frozen=True)
class Join(Rel):
    left: Rel
    right: Rel
    kind: str = "inner"
    on: Expr | None = None
    using: tuple[str, ...] = ()
    asof: bool = False


@dataclass(frozen=True)
class SetOp(Rel):
    kind: str
    left: Rel
    right: Rel
    all: bool = False


@dataclass(frozen=True)
class Dedup(Rel):
    child: Rel


@dataclass(frozen=True)
class Sample(Rel):
    child: Rel
    method: str | None
    size: float
    percent: bool


@dataclass(frozen=True)
class Unnest(Rel):
    """Explode arrays of the child, zipped: new columns for the elements, and a 1-origin ordinal."""

    child: Rel
    arrays: tuple[Expr, ...]
    names: tuple[str, ...]
    ordinality: str | None = None
    outer: bool = False
    table: str | None = None


@dataclass(frozen=True)
class Hint(Rel):
    """cluster by, distribute by, sort by."""

    child: Rel
    kind: str
    keys: tuple[Sort, ...]


@dataclass(frozen=True)
class Test(Rel):
    child: Rel
    check: Expr


@dataclass(frozen=True)
class Debug(Rel):
    child: Rel
    branch: Any


@dataclass(frozen=True)
class Describe(Rel):
    child: Rel


@dataclass(frozen=True)
class Show(Rel):
    what: str
    where: str | None = None


# ----------------------------------------------------------------- statements


class Stmt:
    """A statement."""


@dataclass(frozen=True)
class Query(Stmt):
    relation: Rel


@dataclass(frozen=True)
class Save(Stmt):
    relation: Rel
    target: str
    is_file: bool
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Append(Stmt):
    relation: Rel
    target: str
    is_file: bool
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Delete(Stmt):
    relation: Rel


@dataclass(frozen=True)
class Param:
    name: str
    type: str | None = None
    default: Expr | None = None


@dataclass(frozen=True)
class Model(Stmt):
    name: str
    params: tuple[Param, ...]
    type: str | None
    relation: Rel
    source: str = field(default="", compare=False)


@dataclass(frozen=True)
class Val(Stmt):
    name: str
    type: str | None
    value: Expr


@dataclass(frozen=True)
class TableVal(Stmt):
    name: str
    columns: tuple[tuple[str, str | None], ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Def(Stmt):
    name: str
    params: tuple[Param, ...]
    type: str | None
    body: Expr | None
    context: str | None = None


@dataclass(frozen=True)
class TypeDef(Stmt):
    name: str
    parent: str | None
    context: str | None
    columns: tuple[tuple[str, str], ...]
    methods: tuple[Def, ...]


@dataclass(frozen=True)
class Import(Stmt):
    name: str
    alias: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Package(Stmt):
    name: str


@dataclass(frozen=True)
class Execute(Stmt):
    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class Explain(Stmt):
    target: Stmt | tuple[str | Expr, ...]


@dataclass(frozen=True)
class Use(Stmt):
    name: str


@dataclass(frozen=True)
class ShowQuery(Stmt):
    name: str


# --------------------------------------------------------------------- helpers


def rewrite(node: Any, change) -> Any:
    """A copy of ``node`` with ``change`` applied to every inner expression, top down.

    ``change`` returns a replacement, which is not entered again, or None.
    """
    if isinstance(node, Expr):
        new = change(node)
        if new is not None:
            return new
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if is_dataclass(node):
        return type(node)(**{f.name: rewrite(getattr(node, f.name), change) for f in fields(node)})
    return node


def children(node: Any):
    """The nodes directly inside ``node``."""
    values = node if isinstance(node, tuple) else [getattr(node, f.name) for f in fields(node)] if is_dataclass(node) else []
    for v in values:
        if isinstance(v, tuple) or is_dataclass(v):
            yield v


def walk(node: Any):
    """``node`` and all nodes inside it."""
    yield node
    for x in children(node):
        yield from walk(x)
