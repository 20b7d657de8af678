"""Exact quantiles and histograms without a group's values in one place.

A quantile is one or two order statistics.  Rows are dealt to ranges cut over
(group, value), so a group of very many rows spans ranges and small groups share
one.  Counts by range, one row per group and range, say which range holds a
wanted position; only the rows of these ranges are sorted.  A histogram is a
count by group and value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import global_window as W


def _grouped(df: DataFrame, keys: list[str]) -> tuple[list[str], list[Column]]:
    names = [f"_g{i}" for i in range(len(keys))]
    return names, [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]


def with_group_values(out: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """``out``, a row per group, with the columns that ``values`` has for it beside ``_g0``, ``_g1``, ..."""
    names = [f"_g{i}" for i in range(len(keys))]
    if not keys:
        return out.crossJoin(F.broadcast(values))  # one row
    on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return out.join(values, on, "left").drop(*names)


def exact(df: DataFrame, keys: list[str], x: Column, wanted: dict[str, float], ranges: int | None = None) -> DataFrame:
    """A row per group with the quantiles ``wanted`` (column: share), between two values by their distance; nulls do not count."""
    names, group = _grouped(df, keys)
    rows = df.select(*group, x.cast("double").alias("_x")).where("_x is not null")
    order = [*(W.Key(F.col(n), False, True) for n in names), W.Key(F.col("_x"), False, False)]
    ranges = ranges or W.ranges_of(df)
    dealt = rows.withColumn("_range", W.range_of(order, W.splitters(rows, order, ranges)) if W.supported(rows, order) else F.lit(0))
    sums = dealt.groupBy(*names, "_range").agg(F.count(F.lit(1)).alias("_n"), F.max(F.lit(0)).alias("_all"))
    by = Window.partitionBy(*names, "_all")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("*", before.alias("_before"), F.sum("_n").over(by).alias("_total"))
    spots = {n: F.lit(p) * (F.col("_total") - 1) for n, p in wanted.items()}
    at = F.array_distinct(F.array(*[edge(s).cast("long") for s in spots.values() for edge in (F.floor, F.ceil)]))
    near = sums.withColumn("_at", F.filter(at, lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_n")))).where(F.size("_at") > 0)
    near = near.select(*[F.col(n).alias(f"_of{n}") for n in names], F.col("_range").alias("_of_range"), "_at", "_before", "_total")
    on = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names], F.col("_range") == F.col("_of_range"))
    held = dealt.join(near, on)
    no = F.row_number().over(Window.partitionBy(*names, "_range").orderBy("_x")) - 1 + F.col("_before")
    found = held.withColumn("_no", no).where(F.array_contains("_at", F.col("_no")))
    picked = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_no", "_x"))).alias("_values"), F.max("_total").alias("_total"))  # two values a quantile

    def value(spot: Column) -> Column:
        low, high = F.col("_values")[F.floor(spot).cast("long")], F.col("_values")[F.ceil(spot).cast("long")]
        return F.when(low == high, low).otherwise(low * (F.ceil(spot) - spot) + high * (spot - F.floor(spot)))

    return picked.select(*names, *[value(s).alias(n) for n, s in spots.items()])


def histogram(df: DataFrame, keys: list[str], x: Column, name: str) -> DataFrame:
    """A row per group with a map of its values, by value, to their numbers; nulls do not count."""
    names, group = _grouped(df, keys)
    counts = df.select(*group, x.alias("_x")).where("_x is not null").groupBy(*names, "_x").agg(F.count(F.lit(1)).alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct("_x", "_n")))
    return counts.groupBy(*names).agg(F.map_from_entries(entries).alias(name))
