"""As-of join: for each left row the nearest right row in time, by equal keys.

Rows of both sides are tagged and united; per key, in time order, the last
right row seen is carried to the left rows.  Work is linear in both sides, no
pair of rows is made.  A key with very many rows is no single task's work:
ranges of about equal rows are cut over (key, time) by sampled splitters, so that
a hot key spans ranges and small keys share one.  Rows are carried inside a
(key, range), and what a range needs from the earlier ones is one row per key
and range, which is carried over the ranges in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import global_window as W


def asof_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], left_time: Column, right_time: Column, op: str, keep_left: bool, buckets: int | None = None) -> DataFrame:
    """All columns of ``left`` then of ``right``.

    ``buckets`` is the number of ranges (1: none are cut), else as many as the
    session has shuffle partitions.  ``op`` relates left to right time: ``>=`` and ``>`` take the latest right
    row at or before (strictly before), ``<=`` and ``<`` the next one.  Rows
    with a null key or time match nothing; of right rows with equal key and
    time one is taken.
    """
    back = op in (">=", ">")
    inclusive = op in (">=", "<=")
    # with equal times a right row must come before the left row exactly when it may match
    right_side, left_side = (0, 1) if inclusive else (1, 0)
    names = [f"_k{i}" for i in range(len(keys))]
    own, other = left.columns, right.columns
    l = left.select(*[k.alias(n) for (k, _), n in zip(keys, names, strict=True)], left_time.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_l"))
    r = right.select(*[k.alias(n) for (_, k), n in zip(keys, names, strict=True)], right_time.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("_r"))
    whole = F.col("_t").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    matchable, alone = l.where(whole), l.where(~F.coalesce(whole, F.lit(False)))
    r = r.where(whole)
    both = matchable.select(*names, "_t", F.lit(left_side).alias("_side"), "_l", F.lit(None).cast(r.schema["_r"].dataType).alias("_r")).union(
        r.select(*names, "_t", F.lit(right_side).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType), "_r")
    )
    order = [F.col("_t").asc() if back else F.col("_t").desc(), F.col("_side").asc()]
    # ranges ascend in the order in which rows are carried
    ranked = [*(W.Key(F.col(n), False, True) for n in names), W.Key(F.col("_t"), not back, True)]
    buckets = buckets or W.ranges_of(left)
    if buckets > 1 and W.supported(both, ranked):
        both = both.withColumn("_b", W.range_of(ranked, W.splitters(both, ranked, buckets)))
        rights = both.where("_r is not null")
        latest = F.max_by("_r", F.col("_t")) if back else F.min_by("_r", F.col("_t"))
        ends = rights.groupBy(*names, "_b").agg(latest.alias("_end"))
        wanted = both.select(*names, "_b").distinct().join(ends, [*names, "_b"], "left")
        over = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = wanted.select(*names, "_b", F.last("_end", ignorenulls=True).over(over).alias("_carry"))
        inside = Window.partitionBy(*names, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = both.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).where("_l is not null").join(carried, [*names, "_b"], "left")
        seen = seen.select("_l", F.coalesce("_m", "_carry").alias("_m"))
    else:
        inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = both.select("_l", F.last("_r", ignorenulls=True).over(inside).alias("_m")).where("_l is not null")
    if keep_left:
        seen = seen.union(alone.select("_l", F.lit(None).cast(r.schema["_r"].dataType).alias("_m")))
    else:
        seen = seen.where("_m is not null")
    return seen.select(*[F.col(f"_l.`{c}`").alias(c) for c in own], *[F.col(f"_m.`{c}`").alias(c) for c in other])

