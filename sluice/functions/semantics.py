"""Column helpers that give DuckDB's results where Spark's own differ.

Each helper takes Columns and, where the rule depends on them, Spark types.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: flow type names and their Spark types; int32 and int are 64 bits wide there
TYPE_NAMES = {
    "any": "string", "boolean": "boolean", "byte": "tinyint", "tinyint": "tinyint", "short": "smallint", "smallint": "smallint", "int": "bigint",
    "int32": "bigint", "integer": "bigint", "int64": "bigint", "long": "bigint", "bigint": "bigint", "hugeint": "bigint", "float": "float", "float32": "float",
    "real": "float", "double": "double", "float64": "double", "decimal": "decimal(18,3)", "string": "string", "varchar": "string", "utf8": "string", "char": "string",
    "text": "string", "date": "date", "time": "time", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "interval": "interval", "binary": "binary", "varbinary": "binary",
    "blob": "binary", "json": "variant", "null": "void", "uuid": "string",
}


def spark_type(name: str) -> str:
    """The Spark DDL of a flow type: long, decimal(10,2), array[int], map[string,int]."""
    name = name.strip()
    m = re.fullmatch(r"(\w+)\s*[\[(](.*)[\])]", name, re.DOTALL)
    if m:
        head, inner = m[1].lower(), m[2]
        if head == "array":
            return f"array<{spark_type(inner)}>"
        if head == "map":
            key, value = _split(inner)
            return f"map<{spark_type(key)},{spark_type(value)}>"
        if head in ("row", "struct", "record"):
            return "struct<" + ",".join(f"{f.split(':')[0].strip()}:{spark_type(f.split(':', 1)[1])}" for f in _split(inner)) + ">"
        if head == "decimal":
            return f"decimal({inner})"
        if head in ("varchar", "char"):
            return "string"
        if head in ("timestamp", "time"):
            return TYPE_NAMES[head]
    return TYPE_NAMES.get(name.lower(), name.lower())


def _split(inner: str) -> list[str]:
    depth, out, at = 0, [], 0
    for i, c in enumerate(inner):
        depth += (c in "[(") - (c in "])")
        if c == "," and not depth:
            out.append(inner[at:i])
            at = i + 1
    return [*out, inner[at:]]


def flow_type(kind: T.DataType) -> str:
    """The flow name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"array({flow_type(kind.elementType)})"
    if isinstance(kind, T.MapType):
        return f"map({flow_type(kind.keyType)},{flow_type(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return "{" + ",".join(f"{f.name}:{flow_type(f.dataType)}" for f in kind) + "}"
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    simple = kind.simpleString()
    return {"bigint": "long", "smallint": "short", "tinyint": "byte", "timestamp_ntz": "timestamp", "void": "null", "variant": "json"}.get(simple, simple)


def cast(x: Column, kind: T.DataType | None, to: str, safe: bool = False) -> Column:
    """``x::to``; floating to integer rounds half to even, decimal to integer half up."""
    target = spark_type(to)
    convert = x.try_cast if safe else x.cast
    if target in ("bigint", "int", "smallint", "tinyint"):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            x = F.bround(x, 0)
            convert = x.try_cast if safe else x.cast
        elif isinstance(kind, T.DecimalType):
            x = F.round(x, 0)
            convert = x.try_cast if safe else x.cast
    if target == "string" and isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_text(x, kind)
    if target == "variant" and isinstance(kind, T.StringType):
        return F.parse_json(x)
    return convert(target)


def double_text(x: Column, kind: T.DataType) -> Column:
    """A double's text without an exponent from 1e7 on, where Spark would write one."""
    plain = F.regexp_replace(F.format_string("%.1f", x.cast("double")), "NaN", "nan")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & (x == F.floor(x)), plain).otherwise(x.cast("string"))


def add(left: Column, right: Column, kinds: tuple) -> Column:
    """Numbers are added, strings concatenated."""
    if any(isinstance(k, T.StringType) for k in kinds):
        return F.concat(left.cast("string"), right.cast("string"))
    return left + right


def rounded(x: Column, kind: T.DataType | None, digits: int | None, column: Column) -> Column:
    """Half away from zero; a double is rounded as x * 10^d, not by its decimal digits."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) and digits is not None and 0 < digits < 16:
        scale = float(10**digits)
        return F.round(x.cast("double") * scale, 0) / scale
    return F.round(x, column)


def divide(n: Column, d: Column, literal: object = None) -> Column:
    """Floating division; by zero gives inf, -inf or nan."""
    top, bottom = n.cast("double"), d.cast("double")
    if isinstance(literal, (int, float, Decimal)) and literal:
        return top / bottom
    by_zero = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))).when(top == 0, F.lit(float("nan")))
    return F.when(bottom == 0, by_zero).otherwise(F.try_divide(top, bottom))


def integer_divide(n: Column, d: Column) -> Column:
    return F.call_function("div", n, F.nullif(d, F.lit(0)))


def element(x: Column, kind: T.DataType | None, index: Column) -> Column:
    """1-origin array element (null outside, negative from the end), map value or struct field."""
    if isinstance(kind, T.MapType):
        return F.try_element_at(x, index)
    if isinstance(kind, T.StringType):
        return F.substring(x, index, F.lit(1))
    return F.try_element_at(x, index.cast("int"))


def regexp_replace(x: Column, pattern: str, by: str, flags: str = "") -> Column:
    """First match only, unless flags have g; \\1 in ``by`` names a group."""
    marks = "".join(f for f in flags if f in "ims")
    inline = f"(?{marks})" if marks else ""
    if "g" in flags:
        return F.regexp_replace(x, inline + pattern, re.sub(r"\\(\d)", r"$\1", by))
    shifted = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", by)
    moved = re.sub(r"(?<!\\)\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", pattern)
    return F.regexp_replace(x, f"{inline}(?s)\\A(.*?){moved}", "$1" + shifted)


def array_agg(x: Column) -> Column:
    """All values, nulls too."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def ordered_array_agg(x: Column, keys: list[tuple[Column, bool, bool]]) -> Column:
    """All values by keys (column, descending, nulls first)."""
    packed = F.collect_list(F.struct(*[k.alias(f"k{i}") for i, (k, _, _) in enumerate(keys)], x.alias("v")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, desc, first) in reversed(list(enumerate(keys))):
            p, q = a[f"k{i}"], b[f"k{i}"]
            low, null = (1, -1 if first else 1) if desc else (-1, -1 if first else 1)
            both = F.when(p < q, low).when(p > q, -low).otherwise(out)
            out = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), null).when(q.isNull(), -null).otherwise(both)
        return out

    return F.transform(F.array_sort(packed, compare), lambda s: s["v"])


def interval(text: str) -> Column:
    """'1 year', '3 days 2 hours' and such, also several parts."""
    parts = re.findall(r"(-?\d+)\s*([A-Za-z]+)", text)
    if not parts:
        raise ValueError(f"no interval: {text!r}")
    out = None
    for n, unit in parts:
        unit = unit.lower().rstrip("s")
        if unit == "week":
            n, unit = str(7 * int(n)), "day"
        one = F.expr(f"interval '{n}' {unit}")
        out = one if out is None else out + one
    return out


def sort_key(c: Column, desc: bool, nulls_first: bool) -> Column:
    """Nulls come last in both directions unless asked for first."""
    if desc:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def extract(field: str, x: Column) -> Column:
    """A date field as bigint; Sunday is day 0 of the week."""
    field = field.lower()
    if field in ("dow", "dayofweek", "weekday"):
        return (F.dayofweek(x) - 1).cast("bigint")
    if field == "isodow":
        return (F.weekday(x) + 1).cast("bigint")
    if field == "epoch":
        return F.unix_seconds(x.cast("timestamp")).cast("double")
    if field == "millennium":
        return F.ceil(F.year(x) / 1000).cast("bigint")
    simple = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "week": F.weekofyear, "doy": F.dayofyear, "dayofyear": F.dayofyear}
    if field not in simple:
        raise ValueError(f"no such field: {field}")
    return simple[field](x).cast("bigint")


def json_object(pairs: list[tuple[str, Column]], absent_on_null: bool = False) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]), {} if absent_on_null else {"ignoreNullFields": "false"})


def folded(name: str, x: Column, kind: T.DataType | None) -> Column:
    """Sum, mean, least or greatest of a list's elements that are not null; null if there are none."""
    if name in ("list_min", "list_max"):
        return (F.array_min if name == "list_min" else F.array_max)(x)
    known = F.filter(x, lambda v: v.isNotNull())
    element = kind.elementType if isinstance(kind, T.ArrayType) else None
    whole = isinstance(element, T.IntegralType) and name == "list_sum"
    total = F.aggregate(known, F.lit(0).cast("bigint" if whole else "double"), lambda acc, v: acc + v.cast("bigint" if whole else "double"))
    return F.when(F.size(known) > 0, total / F.size(known) if name == "list_avg" else total)


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """How many borders of a unit lie between two dates or times."""
    unit = unit.lower().removesuffix("s")
    if unit not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise FlowError(f"date_diff knows no unit {unit}")
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, end))


#: Directives of strftime and Spark's letters for them: fixed values.
_DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "f": "SSSSSS", "-d": "d", "-m": "M", "%": "%",
}


def java_format(pattern: str) -> str:
    """A strftime format as Spark's date format."""
    out = []
    for directive, plain in re.findall(r"%(-?[A-Za-z%])|([^%]+)", pattern):
        if plain:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", plain.replace("'", "''")))
        elif directive in _DIRECTIVES:
            out.append(_DIRECTIVES[directive])
        else:
            raise FlowError(f"no format for %{directive}")
    return "".join(out)
