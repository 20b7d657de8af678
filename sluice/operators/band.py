"""Joins on inequalities in opposite directions, by buckets of several widths.

Two inequalities ``a1 <= b1`` and ``b2 <= a2`` between the sides say that the
intervals [a1, a2] and [b2, b1] overlap; a value between two bounds is the case
of an interval without length.  A join on inequalities alone would compare every
pair of rows, so rows meet by bucket instead:

* an interval belongs to the scale of its own length (a power of two, up to the
  rounding of the bounds) and touches two buckets there, seldom three, however
  long it is;
* a pair meets at the longer one's scale, where the shorter one touches no more
  buckets.  So the left rows at their own scale meet right rows of the same or
  smaller ones, and the right rows at theirs meet smaller left rows;
* a pair counts in the first bucket that both touch, so none comes twice, and
  the whole condition is then tested.

Scales are few (at most ``SCALES``), so a row is copied a few times, whatever
the lengths of others.  Outer joins add the rows whose content stands in no pair:
a row looks for one partner, in whichever bucket, and stops at the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths below the greatest value by 2 to this power share a scale.
SCALES = 40
#: Lengths of ``x`` to ``x + 8`` lie around 8 by the rounding of ``x + 8``; so far beyond a power of two they keep its scale.
ROUNDING = 2.0**-16


def measured(x: Column, kind: T.DataType | None) -> Column | None:
    """A number that never falls as the value grows, or None for types without one."""
    if isinstance(kind, T.NumericType):
        return x.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):  # whole days: no time zone moves them
        return F.unix_date(x.cast("date")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("double")
    return None


def scale(length: Column) -> Column:
    """The power of two that a length does not pass, but for rounding."""
    return F.ceil(F.log2(length) - ROUNDING).cast("int")


def comparable(df: DataFrame) -> bool:
    """Whether whole rows can be looked up by their content."""
    return not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema)


def overlap_join(left: DataFrame, right: DataFrame, own: tuple[Column, Column], other: tuple[Column, Column], condition: Column, kind: str = "inner") -> DataFrame:
    """All columns of both sides where ``condition`` holds, which implies that the intervals ``own`` and ``other`` overlap.

    The bounds are measures as of :func:`measured`; bounds the wrong way round
    are turned, which only adds pairs to test.
    """
    peak = max([0.0, *(p for side, bounds in ((left, own), (right, other)) for p in side.agg(*[F.max(F.when(F.abs(c) < float("inf"), F.abs(c))) for c in bounds]).first() if p is not None)])
    edge = F.lit(2 * peak + 1)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small inputs make many pairs, so bytes say little

    def bounded(c: Column) -> Column:  # NaN is the greatest value
        return F.when(F.isnan(c), edge).otherwise(F.least(F.greatest(c, -edge), edge))

    def scaled(df: DataFrame, bounds: tuple[Column, Column], side: str) -> DataFrame:
        low, high = bounded(bounds[0]), bounded(bounds[1])
        whole = bounds[0].isNotNull() & bounds[1].isNotNull()
        out = df.where(whole).withColumn(f"_{side}lo", F.least(low, high)).withColumn(f"_{side}hi", F.greatest(low, high))
        length = F.greatest(F.col(f"_{side}hi") - F.col(f"_{side}lo"), edge * 2.0**-SCALES)
        return out.withColumn(f"_{side}own", scale(length))

    a, b = scaled(left, own, "a"), scaled(right, other, "b")
    scales = [sorted(r[0] for r in x.select(f"_{side}own").distinct().collect()) for x, side in ((a, "a"), (b, "b"))]  # SCALES + 2 each at most

    def placed(df: DataFrame, side: str, at: Column) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col(f"_{side}s"))
        bucket = [F.floor(F.col(f"_{side}{end}") / width) * 64 + F.pmod(F.col(f"_{side}s"), F.lit(64)) for end in ("lo", "hi")]  # one number with the scale
        out = df.withColumn(f"_{side}s", F.explode(at)).withColumn(f"_{side}first", bucket[0])
        return out.withColumn(f"_{side}at", F.explode(F.sequence(F.col(f"_{side}first"), bucket[1], F.lit(64))))

    def of(known: list[int], holds: Callable[[Column], Column]) -> Column:
        return F.filter(F.array(*[F.lit(s) for s in known]).cast("array<int>"), holds)

    def above(known: list[int], side: str, reached: Callable[[Column, int], Column]) -> Column:  # rows that no other can meet are not placed
        return F.filter(F.array(f"_{side}own"), lambda s: reached(s, min(known)) if known else F.lit(False))

    near = (F.col("_aat") == F.col("_bat")) & condition
    once = F.col("_aat") == F.greatest("_afirst", "_bfirst")
    long_left = placed(a, "a", above(scales[1], "a", Column.__ge__)), placed(b, "b", of(scales[0], lambda s: s >= F.col("_bown")))
    long_right = placed(a, "a", of(scales[1], lambda s: s > F.col("_aown"))), placed(b, "b", above(scales[0], "b", Column.__gt__))
    columns = [*left.columns, *right.columns]
    out = [x.repartition(tasks, "_aat").join(y.repartition(tasks, "_bat"), near & once).select(*map(_column, columns)) for x, y in (long_left, long_right)]
    kinds = {f.name: f.dataType for x in out[:1] for f in x.schema}
    for side, first, outer in ((left, 0, ("left", "full")), (right, 1, ("right", "full"))):
        if kind in outer:  # a merge join: a broadcast would do it in as few tasks as the side has files
            met = []
            for ends in (long_left, long_right):
                partners = ends[1 - first].repartition(tasks, f"_{'ba'[first]}at").hint("merge")
                met.append(ends[first].join(partners, near, "left_semi").select(*map(_column, side.columns)))
            out.append(_alone(side, met[0].union(met[1]), kinds))
    return reduce(DataFrame.unionByName, out)


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _alone(side: DataFrame, met: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """Rows of a side that are not ``met``, with nulls for the other side; equal rows are met together or not at all."""
    names = {c: f"_in_{i}" for i, c in enumerate(side.columns)}
    met = met.select(*[_column(c).alias(n) for c, n in names.items()]).distinct()
    on = reduce(Column.__and__, [_column(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    left = side.join(met, on, "left_anti")
    return left.select(*[_column(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
