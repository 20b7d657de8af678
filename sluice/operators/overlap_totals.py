"""Counts and extremes of the rows whose intervals overlap a row's own, without making the pairs.

The bounds of both sides become their places in one order, so intervals are
intervals of whole numbers.  A pair overlaps in one of two ways, never in both:
the other interval begins inside the own one, or the own one begins inside the
other one after its first place.  Either is a point in an interval, and an
interval is put together of at most two aligned stretches of each power of two.
So the other side's rows are aggregated by stretch, and a row looks up the
stretches of its interval and those around its first place: a few dozen rows
each, however many pairs there are.

A condition ``x != y`` beside the overlap is met by taking equal ones away again
from counts, and by keeping the best values of two different ``y`` for extremes.
Intervals whose bounds are the wrong way round are joined as pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import global_window as W

#: Pairs of equal ``x`` and ``y`` that are made, for each row of the sides; beyond that they are counted by stretch too.
DIRECT = 4


@dataclass(frozen=True)
class Overlap:
    """An inner join: ``own[0]`` before ``other[1]`` and ``other[0]`` before ``own[1]``, strictly or not, and ``apart`` unequal."""

    pairs: DataFrame
    join: Callable[[DataFrame, DataFrame], DataFrame]
    left: DataFrame
    right: DataFrame
    own: tuple[Column, Column]
    other: tuple[Column, Column]
    strict: tuple[bool, bool]
    apart: tuple[Column, Column] | None


def totals(o: Overlap, keys: list[str], counts: dict[str, Column | None], extremes: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row per group of ``keys`` of the left side: numbers of pairs (or of values that are not null) and ``min`` or ``max``."""
    tags = ["_tag"] if o.apart else []
    own = [c.alias(n) for c, n in zip((*o.own, *(o.apart or ())[:1]), ("_lo", "_hi", *tags), strict=True)]
    other = [c.alias(n) for c, n in zip((*o.other, *(o.apart or ())[1:]), ("_lo", "_hi", *tags), strict=True)]
    names = {k: f"_of{i}" for i, k in enumerate(keys)}
    group = [F.col(f"`{k}`").alias(n) for k, n in names.items()]
    counted = {"_n": F.lit(1), **{n: F.lit(1) if c is None else c for n, c in counts.items()}}
    given = [*(c.alias(n) for n, c in counted.items()), *(c.alias(n) for n, (_, c) in extremes.items())]
    known = reduce(Column.__and__, [F.col(n).isNotNull() for n in ("_lo", "_hi", *tags)])
    wrong_left = o.own[0] >= o.own[1] if any(o.strict) else o.own[0] > o.own[1]
    wrong_right = o.other[0] > o.other[1]
    left = o.left.where(~F.coalesce(wrong_left, F.lit(False)))
    l = left.select(*group, *own).where(known)
    r = o.right.where(~F.coalesce(wrong_right, F.lit(False))).select(*other, *given).where(known)

    values = reduce(DataFrame.union, [x.select(c) for x in (l, r) for c in ("_lo", "_hi")]).distinct()
    levels = (2 * values.count() + 2).bit_length()
    places = W.spread(values.toDF("_v"), [W.Key(F.col("_v"), False, True)], {"_at": W.Ranked("row_number")})

    def placed(df: DataFrame, first: int, last: int) -> DataFrame:
        for bound, name, shift in (("_lo", "_a", first), ("_hi", "_b", last)):
            at = places.select(F.col("_v").alias(bound), (F.col("_at").cast("long") * 2 + shift).alias(name))
            df = df.join(at, bound)
        return df.drop("_lo", "_hi")

    few = True
    if tags:
        sizes = [x.groupBy("_tag").agg(F.count("*").cast("double").alias(n)) for x, n in ((l, "_i"), (r, "_j"))]
        pairs, rows = sizes[0].join(sizes[1], "_tag", "full").agg(F.sum(F.col("_i") * F.col("_j")), F.sum(F.coalesce("_i", F.lit(0)) + F.coalesce("_j", F.lit(0)))).first()
        few = (pairs or 0) <= DIRECT * (rows or 0)
    l = placed(l, int(o.strict[0]), -int(o.strict[1]))
    r = placed(r, 0, 0)
    found = [_counted(l, r, list(counted), levels, [], 1)]
    if tags:
        if few:
            met = l.alias("l").join(r.alias("r"), "_tag").where("l._a <= r._b and r._a <= l._b")
            found.append(met.select(*names.values(), *[(-F.when(F.col(n).isNotNull(), 1).otherwise(0)).cast("long").alias(n) for n in counted]))
        else:
            found.append(_counted(l, r, list(counted), levels, tags, -1))
    found = [df.select(*names.values(), *counted) for df in found]
    found += [_extremes(l, r, name, kind, levels, tags).select(*names.values(), name) for name, (kind, _) in extremes.items()]
    for a, b, wrong in ((o.left.where(wrong_left), o.right, wrong_left), (left, o.right.where(wrong_right), wrong_right)):
        if not (a if wrong is wrong_left else b).isEmpty():
            pairs = o.join(a, b)
            found.append(pairs.select(*group, *[F.when(c.isNotNull(), 1).otherwise(0).cast("long").alias(n) for n, c in counted.items()], *[c.alias(n) for n, (_, c) in extremes.items()]))
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)
    made = every.groupBy(*names.values()).agg(*[F.sum(n).alias(n) for n in counted], *[(F.min if kind == "min" else F.max)(n).alias(n) for n, (kind, _) in extremes.items()])
    return made.where("_n > 0").select(*[F.col(n).alias(k) for k, n in names.items()], *counts, *extremes)


def _stretches(df: DataFrame, columns: list[str], inside: tuple[str, str], point: str, levels: int, around: bool) -> DataFrame:
    """``df`` by the stretches that make up the interval ``inside`` (of the kind ``around``) and those that hold ``point`` (of the other)."""
    low, high = f"shiftright({inside[0]} + shiftleft(1L, _k) - 1, _k)", f"shiftright({inside[1]} + 1, _k)"
    name = {kind: f"shiftleft(2L * _k + {int(kind)}, 40)" for kind in (False, True)}
    spots = f"""array(if({low} < {high} and {low} % 2 = 1, {name[around]} + {low}, null), if({low} < {high} and {high} % 2 = 1, {name[around]} + {high} - 1, null),
        {name[not around]} + shiftright({point}, _k))"""
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_k"))
    return out.select(*columns, F.explode(F.expr(spots)).alias("_node")).where("_node is not null")


def _asking(l: DataFrame, by: list[str], levels: int) -> DataFrame:
    return _stretches(l.select(*by, "_a", "_b").distinct(), [*by, "_a", "_b"], ("_a", "_b"), "_a", levels, False)


def _offering(r: DataFrame, columns: list[str], levels: int) -> DataFrame:
    return _stretches(r, columns, ("(_a + 1)", "_b"), "_a", levels, True)


def _counted(l: DataFrame, r: DataFrame, columns: list[str], levels: int, by: list[str], sign: int) -> DataFrame:
    alike = r.groupBy(*by, "_a", "_b").agg(*[F.count(n).alias(n) for n in columns])
    nodes = _offering(alike, [*by, *columns], levels).groupBy(*by, "_node").agg(*[F.sum(n).alias(n) for n in columns])
    answers = _asking(l, by, levels).join(nodes, [*by, "_node"]).groupBy(*by, "_a", "_b").agg(*[(F.sum(n) * sign).alias(n) for n in columns])
    return l.join(answers, [*by, "_a", "_b"])


def _extremes(l: DataFrame, r: DataFrame, name: str, kind: str, levels: int, tags: list[str]) -> DataFrame:
    best = F.min if kind == "min" else F.max
    order = F.col(name).asc() if kind == "min" else F.col(name).desc()

    def reduced(df: DataFrame, by: list[str]) -> DataFrame:
        """The best value, or the best values of two tags."""
        few = df.groupBy(*by, *tags).agg(best(name).alias(name))
        if not tags:
            return few
        return few.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_no <= 2").drop("_no")

    alike = reduced(r.where(F.col(name).isNotNull()), ["_a", "_b"])
    nodes = reduced(_offering(alike, [*tags, name], levels), ["_node"])
    answers = reduced(_asking(l, [], levels).join(nodes, "_node"), ["_a", "_b"])
    if not tags:
        return l.join(answers, ["_a", "_b"])
    return l.join(answers.withColumnRenamed("_tag", "_other"), ["_a", "_b"]).where("_tag != _other")
