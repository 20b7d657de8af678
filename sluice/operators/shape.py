"""Pivot, unpivot, sampling and explode over plain DataFrames."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError

#: Columns that a pivot may make.
MOST_PIVOT_VALUES = 10_000


def distinct_values(df: DataFrame, name: str) -> list:
    """A column's distinct values in order, without null; few enough to be columns, or an error."""
    found = df.select(F.col(f"`{name}`").alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_PIVOT_VALUES + 1).collect()
    if len(found) > MOST_PIVOT_VALUES:
        raise FlowError(f"pivot on {name} would make more than {MOST_PIVOT_VALUES} columns")
    return [r[0] for r in found]


def pivot(df: DataFrame, on: list[tuple[str, list | None]], group: list[str], aggregates: list[tuple[str, Column, bool]]) -> DataFrame:
    """``group`` columns, then one column per value (and aggregate).

    ``aggregates`` are (name, aggregate, counts): counts show 0 for absent
    values.  Several ``on`` columns make a column per combination of values.
    """
    values = [v if v is not None else distinct_values(df, n) for n, v in on]
    if len(on) == 1:
        key, wanted = F.col(f"`{on[0][0]}`"), values[0]
        labels = [_label(v) for v in wanted]
    else:
        # a combination is known by its number, so values that hold the separator, or nulls, never meet
        key = F.lit(0)
        for (n, _), own in zip(on, values, strict=True):
            place = F.array_position(F.array(*[F.lit(v) for v in own]).cast(T.ArrayType(df.schema[n].dataType)), F.col(f"`{n}`"))
            key = key * len(own) + F.when(place > 0, place - 1)
        labels = ["_".join(_label(v) for v in combination) for combination in itertools.product(*values)]
        wanted = list(range(len(labels)))
    dealt = df.withColumn("_pivot", key).groupBy(*[F.col(f"`{g}`") for g in group]).pivot("_pivot", wanted)
    out = dealt.agg(*[c.alias(n) for n, c, _ in aggregates])
    several = len(aggregates) > 1
    made = out.columns[len(group) :]
    columns = [F.col(f"`{g}`") for g in group]
    for name, (label, (agg, _, counts)) in zip(made, itertools.product(labels, aggregates), strict=True):
        c = F.col(f"`{name}`")
        columns.append((F.coalesce(c, F.lit(0)) if counts else c).alias(f"{label}_{agg}" if several else label))
    return out.select(*columns)


def _label(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def unpivot(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """A row per column and row whose value is not null."""
    ids = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.unpivot(ids, [F.col(f"`{c}`") for c in columns], name, value).where(F.col(f"`{value}`").isNotNull())


def sample(df: DataFrame, method: str, size: float, percent: bool, seed: int | None = None) -> DataFrame:
    """Reservoir: exactly so many rows (or that share of them); system and bernoulli: each row by chance."""
    if percent and method in ("system", "bernoulli"):
        return df.sample(withReplacement=False, fraction=min(1.0, size / 100), seed=seed)
    n = math.ceil(df.count() * size / 100) if percent else int(size)
    if n < 100_000:
        return df.orderBy(F.rand(seed)).limit(n)  # a top-n by a random key
    total = df.count()
    if n >= total:
        return df
    # thin out first, so that the sort holds little more than the sample
    share = min(1.0, (n + 6 * math.sqrt(n) + 100) / total)
    return df.sample(False, share, seed).orderBy(F.rand(seed)).limit(n)
