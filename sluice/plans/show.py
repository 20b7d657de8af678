"""Expressions as text: default names of output columns, plans to read."""

from __future__ import annotations

from dataclasses import fields
from typing import Any

from sluice.plans import ast as A


def show_expr(e: A.Expr) -> str:
    """The name that a column without one gets."""
    match e:
        case A.Lit(value):
            return "null" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
        case A.Col(name):
            return name
        case A.Here():
            return "_"
        case A.This():
            return "this"
        case A.Star(q):
            return f"{q}.*" if q else "*"
        case A.Dot(A.Here(), "count", _):
            return "count_star()"
        case A.Dot(base, name, None):
            return f"{name}({show_expr(base)})"
        case A.Dot(base, name, args):
            return f"{name}({', '.join([show_expr(base), *(show_expr(a.value) for a in args)])})"
        case A.Call("count", (A.Arg(A.Star(), None),)):
            return "count_star()"
        case A.Call(name, args):
            return f"{name}({', '.join(show_expr(a.value) for a in args)})"
        case A.Bin(op, left, right):
            return f"({show_expr(left)} {op.upper() if op.isalpha() else op} {show_expr(right)})"
        case A.Un(op, inner):
            return f"({op} {show_expr(inner)})" if op.isalpha() else f"{op}{show_expr(inner)}"
        case A.Cast(inner, kind, _):
            return f"CAST({show_expr(inner)} AS {kind})"
        case A.Index(inner, index):
            return f"{show_expr(inner)}[{show_expr(index)}]"
        case A.ArrayOf(items):
            return f"[{', '.join(map(show_expr, items))}]"
        case A.Over(inner):
            return f"{show_expr(inner)} OVER (...)"
        case A.Case():
            return "CASE ... END"
        case A.Sub() | A.Exists():
            return "subquery"
        case A.Typed(text, kind):
            return f"{kind} '{text}'"
        case A.Text(parts) | A.RawSql(parts):
            return "".join(p if isinstance(p, str) else "${" + show_expr(p) + "}" for p in parts)
    return type(e).__name__.lower()


def show_plan(node: Any, depth: int = 0) -> str:
    """An indented tree of a relation's nodes, the last operator first."""
    pad = "  " * depth
    if isinstance(node, A.Rel):
        own, inner = [], []
        for f in fields(node):
            v = getattr(node, f.name)
            if isinstance(v, A.Rel) or (isinstance(v, tuple) and v and all(isinstance(x, A.Rel) for x in v)):
                inner += v if isinstance(v, tuple) else [v]
            elif v not in (None, (), False):
                own.append(f"{f.name}={_brief(v)}")
        return "\n".join([f"{pad}{type(node).__name__}({', '.join(own)})", *(show_plan(x, depth + 1) for x in inner)])
    return f"{pad}{_brief(node)}"


def _brief(v: Any) -> str:
    if isinstance(v, A.Expr):
        return show_expr(v)
    if isinstance(v, A.Item):
        return show_expr(v.expr) + (f" as {v.name}" if v.name else "")
    if isinstance(v, A.Sort):
        return show_expr(v.expr) + (" desc" if v.desc else "")
    if isinstance(v, tuple):
        return "[" + ", ".join(map(_brief, v)) + "]"
    return str(v)
