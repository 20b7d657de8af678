"""Columns in scope: which names a relation's columns answer to.

Every column has an internal name, unique in its DataFrame, besides the name it
shows; joins may show a name twice.  An unqualified name means its first
column; shown duplicates get ``_1``, ``_2``, … at the end only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import FlowNameError
from sluice.operators.overlap_totals import Overlap
from sluice.plans import ast as A


_COUNTER = itertools.count()


def fresh_name(what: str) -> str:
    """An internal name that stands nowhere else."""
    return f"_{what}{next(_COUNTER)}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Named:
    name: str
    internal: str
    qualifiers: frozenset[str] = frozenset()

    @property
    def column(self) -> Column:
        return F.col(quoted(self.internal))


@dataclass(frozen=True)
class Scope:
    """A DataFrame and its named columns; ``group`` holds a pending group by, ``exact`` says that there are no others.

    ``overlap`` says of what join the DataFrame ``overlap.pairs`` is the result.
    """

    df: DataFrame
    columns: tuple[Named, ...]
    group: Group | None = None
    exact: bool = False
    overlap: Overlap | None = None

    @staticmethod
    def of(df: DataFrame, qualifier: str | None = None) -> Scope:
        internal, shown = [], df.columns
        for name in shown:
            internal.append(_fresh(name, internal))
        if internal != shown:
            df = df.toDF(*internal)
        q = frozenset([qualifier]) if qualifier else frozenset()
        return Scope(df, tuple(Named(n, i, q) for n, i in zip(shown, internal, strict=True)))

    def find(self, name: str, qualifier: str | None = None) -> Named | None:
        own = [c for c in self.columns if qualifier is None or qualifier.lower() in {q.lower() for q in c.qualifiers}]
        return next((c for c in own if c.name == name), None) or next((c for c in own if c.name.lower() == name.lower()), None)

    def has_qualifier(self, name: str) -> bool:
        return any(name.lower() == q.lower() for c in self.columns for q in c.qualifiers)

    def need(self, name: str) -> Named:
        found = self.find(name)
        if found is None:
            raise FlowNameError(f"no column {name}; there are {', '.join(c.name for c in self.columns)}")
        return found

    def aliased(self, name: str, columns: Iterable[str] = ()) -> Scope:
        shown = list(columns) or [c.name for c in self.columns]
        if len(shown) != len(self.columns):
            raise FlowNameError(f"{name} names {len(shown)} columns of {len(self.columns)}")
        q = frozenset([name])
        return replace(self, columns=tuple(Named(n, c.internal, q) for n, c in zip(shown, self.columns, strict=True)))

    def pick(self, columns: Iterable[Named]) -> Scope:
        columns = tuple(columns)
        return Scope(self.df.select(*[c.column for c in columns]), columns)

    def project(self, items: list[tuple[str, Column, frozenset[str]]], distinct: bool = False) -> Scope:
        """New columns from (shown name, column, qualifiers)."""
        internal: list[str] = []
        for name, _, _ in items:
            internal.append(_fresh(name, internal))
        df = self.df.select(*[c.alias(i) for (_, c, _), i in zip(items, internal, strict=True)])
        return Scope(df.distinct() if distinct else df, tuple(Named(n, i, q) for (n, _, q), i in zip(items, internal, strict=True)))

    def shown(self) -> DataFrame:
        """The DataFrame under the names that it shows."""
        names: list[str] = []
        seen: dict[str, int] = {}
        for c in self.columns:
            n = seen.get(c.name.lower(), 0)
            seen[c.name.lower()] = n + 1
            names.append(f"{c.name}_{n}" if n else c.name)
        df = self.df.select(*[c.column for c in self.columns]) if self.df.columns != [c.internal for c in self.columns] else self.df
        return df if df.columns == names else df.toDF(*names)

    def isolated(self) -> Scope:
        """The same relation under internal names that stand nowhere else.

        A subquery refers to it by these: Spark looks for an outer name inside
        the subquery's own plan first, down to its scans.
        """
        no = next(_COUNTER)
        new = tuple(replace(c, internal=f"_o{no}_{c.internal}") for c in self.columns)
        return replace(self, df=self.df.select(*[c.column.alias(n.internal) for c, n in zip(self.columns, new, strict=True)]), columns=new)

    def beside(self, other: Scope) -> Scope:
        """``other`` with internal names that do not clash with this scope's."""
        taken = [c.internal for c in self.columns]
        new, renamed = [], []
        for c in other.columns:
            name = _fresh(c.internal, [*taken, *new])
            new.append(name)
            renamed.append(replace(c, internal=name))
        return Scope(other.df.select(*[c.column.alias(n) for c, n in zip(other.columns, new, strict=True)]), tuple(renamed))


def _fresh(name: str, taken: list[str]) -> str:
    low = {t.lower() for t in taken}
    out, n = name, 1
    while out.lower() in low:
        out, n = f"{name}__{n}", n + 1
    return out


@dataclass(frozen=True)
class Group:
    """A pending group by: keys as (shown name, expression, column in the scope), and filters on the groups."""

    keys: tuple[tuple[str, A.Expr, Named], ...]
    filters: tuple[A.Expr, ...] = ()
    sets: object = field(default=None)
