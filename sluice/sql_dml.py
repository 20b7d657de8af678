"""UPDATE, DELETE and MERGE on plain tables.

A statement becomes a relation of acted rows: the file and the position of each
row that changes, and its new values.  Only files that hold such a row are
written anew (:mod:`sluice.sources.touched`); a table with partitions is
replaced as a whole.

MERGE takes the first WHEN clause of its kind whose condition holds, for each
row.  Two source rows that would change one row are an error, as either could win.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import FlowError
from sluice.sources import touched
from sluice.sources.touched import FILE, ROW

if TYPE_CHECKING:
    from sluice.engine import Engine

_NAME = r"[\w.]+"
_WHEN = r"when\s+(?:not\s+)?matched\b"


def run_dml(engine: Engine, text: str) -> DataFrame | None:
    """The statement's effect, or None if it is another kind of statement."""
    statement = _Statement(engine, text)
    for word, run in (("update", statement.update), ("delete", statement.delete), ("merge", statement.merge)):
        if re.match(rf"{word}\s", text, re.IGNORECASE):
            return run()
    return None


def at_top(text: str, pattern: str, start: int = 0) -> re.Match | None:
    """The first match outside of brackets."""
    depth = 0
    found = re.compile(rf"\b(?:{pattern})", re.IGNORECASE)
    for i in range(start, len(text)):
        depth += (text[i] in "([") - (text[i] in ")]")
        if depth == 0 and (m := found.match(text, i)) and (i == 0 or not text[i - 1].isalnum()):
            return m
    return None


class _Statement:
    def __init__(self, engine: Engine, text: str):
        from sluice.sql_front import shielded

        self.engine = engine
        self.spark = engine.spark
        self.text, self.kept = shielded(text)
        self.text = self.text.strip()

    def sql(self, part: str) -> str:
        from sluice.sql_front import spark_dialect, unshielded

        return spark_dialect(unshielded(part.strip(), self.kept))

    def done(self, what: str) -> DataFrame:
        return self.spark.createDataFrame([(what,)], "result string")

    def assignments(self, text: str) -> dict[str, str]:
        from sluice.sql_front import split_list

        pairs = (p.split("=", 1) for p in split_list(text))
        return {k.strip().strip("`").rsplit(".", 1)[-1].lower(): self.sql(v) for k, v in pairs}

    # ------------------------------------------------------------------ UPDATE and DELETE

    def parts(self, head: str) -> tuple[str, str | None, str, str | None]:
        """Table, alias, what stands before a top-level WHERE, and the condition."""
        m = re.match(rf"{head}\s+({_NAME})(?:\s+(?:as\s+)?(?!set\b|where\b)(\w+))?\s*", self.text, re.IGNORECASE)
        if not m:
            raise FlowError(f"cannot read {self.text.split()[0]}")
        where = at_top(self.text, r"where\b", m.end())
        return m[1], m[2], self.text[m.end() : where.start() if where else len(self.text)], self.text[where.end() :] if where else None

    def update(self) -> DataFrame:
        table, alias, sets, where = self.parts("update")
        m = re.match(r"set\s+(.*)$", sets.strip(), re.IGNORECASE | re.DOTALL)
        if not m:
            raise FlowError("update needs set")
        rows = touched.numbered(self.spark, table).alias(alias or table.rsplit(".", 1)[-1])
        new = self.assignments(m[1])
        hit = rows.where(F.expr(self.sql(where))) if where else rows
        touched.apply(self.spark, table, _acted(self.spark.table(table), hit, new, []))
        return self.done("updated")

    def delete(self) -> DataFrame:
        table, alias, _, where = self.parts(r"delete\s+from")
        rows = touched.numbered(self.spark, table).alias(alias or table.rsplit(".", 1)[-1])
        hit = rows.where(F.expr(self.sql(where))) if where else rows
        touched.apply(self.spark, table, hit.select(FILE, ROW, F.lit(True).alias("_gone")))
        return self.done("deleted")

    # ------------------------------------------------------------------ MERGE

    def merge(self) -> DataFrame:
        from sluice.sql_front import closing

        m = re.match(rf"merge\s+into\s+({_NAME})(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s*", self.text, re.IGNORECASE)
        if not m:
            raise FlowError("cannot read merge")
        table, t = m[1], m[2] or m[1].rsplit(".", 1)[-1]
        end = closing(self.text, m.end()) + 1 if self.text[m.end()] == "(" else re.compile(_NAME).match(self.text, m.end()).end()
        using = self.text[m.end() : end]
        named = re.compile(r"\s*(?:as\s+)?(?!on\b)(\w+)?\s*on\s", re.IGNORECASE).match(self.text, end)
        first = at_top(self.text, _WHEN, named.end()) if named else None
        if first is None:
            raise FlowError("merge needs on and when")
        s = named[1] or ("source" if using.startswith("(") else using.rsplit(".", 1)[-1])
        on = F.expr(self.sql(self.text[named.end() : first.start()]))
        source = (self.spark.sql(self.sql(using[1:-1])) if using.startswith("(") else self.spark.table(using)).alias(s)
        matched, unmatched = [], []
        while first is not None:
            following = at_top(self.text, _WHEN, first.end())
            body = self.text[first.end() : following.start() if following else len(self.text)]
            then = at_top(body, r"then\b")
            if then is None or re.match(r"\s*by\b", body, re.IGNORECASE):
                raise FlowError(f"merge: cannot read when {body.strip()!r}")
            extra = re.match(r"\s*and\b(.*)$", body[: then.start()], re.IGNORECASE | re.DOTALL)
            condition = F.coalesce(F.expr(self.sql(extra[1])), F.lit(False)) if extra else F.lit(True)
            (unmatched if " not " in f" {' '.join(first[0].lower().split())} " else matched).append((condition, body[then.end() :].strip()))
            first = following

        target = self.spark.table(table)
        rows = touched.numbered(self.spark, table).alias(t)
        acted = None
        if matched:
            acted = self.changed(target, rows.join(source, on), matched, t, s)
            if acted.groupBy(FILE, ROW).count().where("count > 1").limit(1).count():
                raise FlowError("merge: two source rows match one row of the table")
        added = self.added(target, source.join(rows, on, "left_anti"), unmatched, source.columns) if unmatched else None
        touched.apply(self.spark, table, acted, added)
        return self.done("merged")

    def changed(self, target: DataFrame, pairs: DataFrame, clauses: list[tuple[Column, str]], t: str, s: str) -> DataFrame:
        """Pairs that a clause takes, with their new values; the first clause that holds wins."""
        sets = []
        for _, action in clauses:
            if re.fullmatch(r"delete", action, re.IGNORECASE):
                sets.append(None)
            elif m := re.fullmatch(r"update\s+set\s+(.*)", action, re.IGNORECASE | re.DOTALL):
                sets.append({c.lower(): f"`{s}`.`{c}`" for c in target.columns} if m[1].strip() == "*" else self.assignments(m[1]))
            else:
                raise FlowError(f"merge: a matched row is updated or deleted, not {action!r}")
        return _acted(target, pairs, None, [(c, v) for (c, _), v in zip(clauses, sets, strict=True)], t)

    def added(self, target: DataFrame, rest: DataFrame, clauses: list[tuple[Column, str]], given: list[str]) -> DataFrame:
        """Source rows without a match, by the first clause that holds."""
        from sluice.sql_front import split_list

        values: list[dict[str, str]] = []
        for _, action in clauses:
            if re.fullmatch(r"insert\s*\*", action, re.IGNORECASE):
                values.append({c.lower(): f"`{c}`" for c in given})
                continue
            m = re.match(r"insert\s*(?:\(([^()]*)\))?\s*values\s*(?=\()", action, re.IGNORECASE)
            if not m:
                raise FlowError(f"merge: cannot insert by {action!r}")
            names = [n.strip().strip("`").lower() for n in m[1].split(",")] if m[1] else [c.lower() for c in target.columns]
            exprs = [self.sql(v) for v in split_list(action[m.end() + 1 : action.rindex(")")])]
            if len(names) != len(exprs):
                raise FlowError(f"merge: {len(exprs)} values into {len(names)} columns")
            values.append(dict(zip(names, exprs, strict=True)))
        if unknown := [n for v in values for n in v if n not in {c.lower() for c in target.columns}]:
            raise FlowError(f"merge: no column {unknown[0]}")
        which = _first([c for c, _ in clauses])
        taken = rest.withColumn("_clause", which).where(F.col("_clause").isNotNull())
        return taken.select(*[_by_clause([F.expr(v[f.name.lower()]) if f.name.lower() in v else F.lit(None) for v in values]).cast(f.dataType).alias(f.name) for f in target.schema])


def _first(conditions: list[Column]) -> Column:
    """Number of the first condition that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])


def _by_clause(values: list[Column]) -> Column:
    return reduce(lambda out, v: out.when(F.col("_clause") == v[0], v[1]), enumerate(values[1:], 1), F.when(F.col("_clause") == 0, values[0]))


def _acted(target: DataFrame, rows: DataFrame, new: dict[str, str] | None, clauses: list[tuple[Column, dict[str, str] | None]], t: str | None = None) -> DataFrame:
    """(file, row, _gone, new values) of the rows that one assignment, or the first clause that holds, changes."""
    clauses = clauses or [(F.lit(True), new)]
    known = {f.name.lower() for f in target.schema}
    if unknown := [n for _, v in clauses for n in v or () if n not in known]:
        raise FlowError(f"no column {unknown[0]}")
    old = {f.name: F.col(f"`{t}`.`{f.name}`" if t else f"`{f.name}`") for f in target.schema}
    taken = rows.withColumn("_clause", _first([c for c, _ in clauses])).where(F.col("_clause").isNotNull())
    gone = F.col("_clause").isin([i for i, (_, v) in enumerate(clauses) if v is None])
    values = [
        _by_clause([F.expr(v[f.name.lower()]).cast(f.dataType) if v and f.name.lower() in v else old[f.name] for _, v in clauses]).alias(f"_new_{f.name}")
        for f in target.schema
    ]
    return taken.select(FILE, ROW, gone.alias("_gone"), *values)
