"""Results as text: boxes, tab-separated values, JSON lines."""

from __future__ import annotations

import datetime
import json
import unicodedata
from decimal import Decimal
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from sluice.functions.semantics import flow_type


def width(text: str) -> int:
    """Columns that a text takes in a terminal."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def plain(v: Any) -> Any:
    """A value as Python data that tests and JSON can compare."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() and v.as_tuple().exponent >= 0 else float(v)
    if isinstance(v, (datetime.date, datetime.time)):
        return str(v)
    return v


def cell(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={cell(x)}" for k, x in v.items()) + "}"
    if isinstance(v, Row):
        return cell(v.asDict())
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(cell, v)) + "]"
    return str(v)


def box(schema: T.StructType, rows: list[Row], total: int | None = None) -> str:
    """A table with names and types in its head; numbers stand to the right."""
    if not len(schema):
        return f"{len(rows)} rows"
    names, kinds = [f.name for f in schema], [flow_type(f.dataType) for f in schema]
    cells = [[cell(v) for v in r] for r in rows]
    wide = [max([width(n), width(k), *(width(r[i]) for r in cells)]) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    foot = f"{total if total is not None else len(rows)} rows"
    inner = sum(wide) + 3 * len(wide) - 3
    if width(foot) > inner:
        wide[-1] += width(foot) - inner
        inner = width(foot)

    def pad(text: str, n: int, how: str) -> str:
        space = n - width(text)
        return " " * (space // 2) + text + " " * (space - space // 2) if how == "^" else " " * space + text if how == ">" else text + " " * space

    def line(values: list[str], how: list[str]) -> str:
        return "│ " + " │ ".join(pad(v, n, h) for v, n, h in zip(values, wide, how, strict=True)) + " │"

    def rule(a: str, b: str, c: str) -> str:
        return a + b.join("─" * (n + 2) for n in wide) + c

    right = [">" if isinstance(f.dataType, T.NumericType) else "<" for f in schema]
    centre = ["^"] * len(wide)
    out = [rule("┌", "┬", "┐"), line(names, centre), line(kinds, centre), rule("├", "┼", "┤")]
    out += [line(r, right) for r in cells]
    out += [rule("├", "┴", "┤"), "│ " + pad(foot, inner, "<") + " │", "└" + "─" * (inner + 2) + "┘"]
    return "\n".join(out)


def tsv(schema: T.StructType, rows: list[Row]) -> str:
    return "\n".join(["\t".join(f.name for f in schema), *("\t".join("" if v is None else cell(v) for v in r) for r in rows)])


def json_lines(schema: T.StructType, rows: list[Row]) -> str:
    names = [f.name for f in schema]
    return "\n".join(json.dumps(dict(zip(names, map(plain, r), strict=True)), ensure_ascii=False, separators=(",", ":")) for r in rows)
