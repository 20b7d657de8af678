"""Functions and methods by name.

``SCALARS`` are functions whose name or result differs from Spark's; any other
name goes to Spark's own function.  ``AGGREGATES`` take the columns of a group;
``METHODS`` take their receiver first.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import semantics as S

# Aggregates -------------------------------------------------------------------


def _double(x: Column, kind: T.DataType | None) -> Column:
    return x.cast("double") if isinstance(kind, T.DecimalType) else x


def _histogram(values: Column) -> Column:
    """Each value with its number, by value; nulls do not count."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).cast("bigint"))))


#: name -> (columns, type of the first) -> aggregate
AGGREGATES: dict[str, Callable[[list[Column], T.DataType | None], Column]] = {
    "sum": lambda a, k: F.sum(a[0]),
    "avg": lambda a, k: F.avg(_double(a[0], k)),
    "mean": lambda a, k: F.avg(_double(a[0], k)),
    "count": lambda a, k: F.count(a[0]) if a else F.count(F.lit(1)),
    "count_star": lambda a, k: F.count(F.lit(1)),
    "count_distinct": lambda a, k: F.count_distinct(*a),
    "count_if": lambda a, k: F.count_if(a[0]),
    "countif": lambda a, k: F.count_if(a[0]),
    "min": lambda a, k: F.min(a[0]),
    "max": lambda a, k: F.max(a[0]),
    "min_by": lambda a, k: F.min_by(a[0], a[1]),
    "max_by": lambda a, k: F.max_by(a[0], a[1]),
    "arg_min": lambda a, k: F.min_by(a[0], a[1]),
    "arg_max": lambda a, k: F.max_by(a[0], a[1]),
    "arbitrary": lambda a, k: F.first(a[0]),
    "any": lambda a, k: F.first(a[0]),
    "first": lambda a, k: F.first(a[0]),
    "last": lambda a, k: F.last(a[0]),
    "any_value": lambda a, k: F.first(a[0], ignorenulls=True),
    "median": lambda a, k: F.median(_double(a[0], k)),
    "variance": lambda a, k: F.var_samp(a[0]),
    "var_samp": lambda a, k: F.var_samp(a[0]),
    "var_pop": lambda a, k: F.var_pop(a[0]),
    "stddev": lambda a, k: F.stddev_samp(a[0]),
    "stddev_samp": lambda a, k: F.stddev_samp(a[0]),
    "stddev_pop": lambda a, k: F.stddev_pop(a[0]),
    "corr": lambda a, k: F.corr(a[0], a[1]),
    "covar_samp": lambda a, k: F.covar_samp(a[0], a[1]),
    "covar_pop": lambda a, k: F.covar_pop(a[0], a[1]),
    "skewness": lambda a, k: F.skewness(a[0]),
    "bool_and": lambda a, k: F.bool_and(a[0]),
    "bool_or": lambda a, k: F.bool_or(a[0]),
    "approx_distinct": lambda a, k: F.approx_count_distinct(a[0]),
    "approx_count_distinct": lambda a, k: F.approx_count_distinct(a[0]),
    "count_approx_distinct": lambda a, k: F.approx_count_distinct(a[0]),
    "approx_quantile": lambda a, k: F.approx_percentile(a[0], a[1]),
    "approx_percentile": lambda a, k: F.approx_percentile(a[0], a[1]),
    "quantile": lambda a, k: F.percentile(a[0], a[1]),
    "quantile_cont": lambda a, k: F.percentile(a[0], a[1]),
    "array_agg": lambda a, k: S.array_agg(a[0]),
    "to_array": lambda a, k: S.array_agg(a[0]),
    "list": lambda a, k: S.array_agg(a[0]),
    "collect_list": lambda a, k: F.collect_list(a[0]),
    "collect_set": lambda a, k: F.collect_set(a[0]),
    "string_agg": lambda a, k: F.listagg(a[0], a[1] if len(a) > 1 else F.lit(",")),
    "listagg": lambda a, k: F.listagg(a[0], a[1] if len(a) > 1 else F.lit(",")),
    "grouping": lambda a, k: F.grouping(a[0]),
    "histogram": lambda a, k: _histogram(F.collect_list(a[0])),
}
AGGREGATES["kurtosis"] = lambda a, k: F.kurtosis(a[0])

#: aggregate methods, on a grouped column; ``count`` counts rows whatever the receiver
AGGREGATE_METHODS = frozenset(
    "sum avg count count_distinct count_if min max min_by max_by arbitrary any any_value median variance stddev approx_quantile count_approx_distinct to_array".split()
)
DISTINCT = {"sum": F.sum_distinct, "count": F.count_distinct}

# Window functions -------------------------------------------------------------

WINDOWS: dict[str, Callable[[list[Column], bool], Column]] = {
    "rank": lambda a, i: F.rank(),
    "dense_rank": lambda a, i: F.dense_rank(),
    "row_number": lambda a, i: F.row_number(),
    "percent_rank": lambda a, i: F.percent_rank(),
    "cume_dist": lambda a, i: F.cume_dist(),
    "first_value": lambda a, i: F.first(a[0], ignorenulls=i),
    "last_value": lambda a, i: F.last(a[0], ignorenulls=i),
}

# Scalars ----------------------------------------------------------------------


def _concat(a: list[Column]) -> Column:
    return F.concat_ws("", *a)


SCALARS: dict[str, Callable[[list[Column]], Column]] = {
    "concat": _concat,
    "coalesce": lambda a: F.coalesce(*a),
    "nullif": lambda a: F.nullif(a[0], a[1]),
    "ifnull": lambda a: F.coalesce(*a),
    "ceiling": lambda a: F.ceil(a[0]),
    "strlen": lambda a: F.octet_length(a[0]),
    "substr": lambda a: F.substring(a[0], a[1], a[2]) if len(a) > 2 else F.substr(a[0], a[1]),
    "substring": lambda a: F.substring(a[0], a[1], a[2]) if len(a) > 2 else F.substr(a[0], a[1]),
    "starts_with": lambda a: F.startswith(a[0], a[1]),
    "ends_with": lambda a: F.endswith(a[0], a[1]),
    "regexp_like": lambda a: F.regexp_like(a[0], a[1]),
    "regexp_extract": lambda a: F.call_function("regexp_extract", a[0], a[1], a[2] if len(a) > 2 else F.lit(0)),
    "epoch": lambda a: F.unix_micros(a[0].cast("timestamp")) / F.lit(1e6),
    "json_extract": lambda a: F.call_function("get_json_object", a[0], a[1]),
    "regexp_matches": lambda a: F.regexp_like(a[0], a[1]),
    "strpos": lambda a: F.instr(a[0], a[1]) if isinstance(a[1], str) else F.call_function("instr", a[0], a[1]),
    "list_contains": lambda a: F.array_contains(a[0], a[1]),
    "contains": lambda a: F.contains(a[0], a[1]),
    "list_value": lambda a: F.array(*a),
    "array_concat": lambda a: F.concat(*a),
    "list_concat": lambda a: F.concat(*a),
    "list_distinct": lambda a: F.array_distinct(a[0]),
    "list_sort": lambda a: F.sort_array(a[0]),
    "array_length": lambda a: F.size(a[0]),
    "len": lambda a: F.length(a[0]),
    "cardinality": lambda a: F.size(a[0]),
    "date_diff": lambda a: F.call_function("datediff", a[1], a[0]),
    "today": lambda a: F.current_date(),
    "now": lambda a: F.current_timestamp(),
    "at_time_zone": lambda a: F.from_utc_timestamp(a[0], a[1]),
    "json_extract_string": lambda a: F.call_function("get_json_object", a[0], a[1]),
    "to_json": lambda a: F.to_json(a[0], {"ignoreNullFields": "false"}),
    "unnest": lambda a: F.explode(a[0]),
    "map": lambda a: F.map_from_arrays(a[0], a[1]),
    "row": lambda a: F.struct(*a),
    "struct": lambda a: F.struct(*a),
    "hash": lambda a: F.xxhash64(*a),
    "current_date": lambda a: F.current_date(),
    "current_timestamp": lambda a: F.current_timestamp(),
    "localtimestamp": lambda a: F.localtimestamp(),
    "ulid_string": lambda a: F.lit(ulid()),
    "uuid": lambda a: F.uuid(),
    "trim": lambda a: F.trim(*a),
    "ltrim": lambda a: F.ltrim(*a),
    "rtrim": lambda a: F.rtrim(*a),
}

#: names taken as functions without parentheses
BARE = frozenset(["current_date", "current_timestamp", "localtimestamp", "ulid_string"])

#: name -> Spark higher-order function; lambdas are Python callables
HIGHER: dict[str, Callable[..., Column]] = {
    "list_transform": F.transform, "transform": F.transform, "list_filter": F.filter, "array_filter": F.filter, "filter": F.filter,
    "any_match": F.exists, "all_match": F.forall, "map_filter": F.map_filter, "transform_values": F.transform_values, "zip_with": F.zip_with,
}

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid() -> str:
    """A new ULID: 48 bits of time, 80 random bits, in Crockford's base 32."""
    n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    return "".join(_CROCKFORD[(n >> shift) & 31] for shift in range(125, -1, -5))
