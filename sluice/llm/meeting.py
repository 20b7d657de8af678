"""Bring the texts of many pairs of rows together without hot groups."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import drop_stored, spread_join, stored

#: Spark's own runtime filter: a Bloom filter of bounded size, made on the executors from the rows
#: that a shuffle join needs, drops the other texts where they are read.
_RUNTIME_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


@contextlib.contextmanager
def runtime_filter(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned inside may filter their large side early; the settings are put back."""
    before = {k: spark.conf.get(k, None) for k in _RUNTIME_FILTER}
    for k, v in _RUNTIME_FILTER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Text bytes of a group of pairs, and of a salted part of one anchor's pairs twice that at most.
GROUP_BYTES = 8 << 20


def meet(pairs: DataFrame, texts: DataFrame, look: Callable[[pa.Table, pa.Table], pa.Table], schema: str, group: int, rows: DataFrame | None = None) -> DataFrame:
    """``look(texts, pairs)`` over groups of about ``group`` first rows or ``GROUP_BYTES``, if fewer; its rows, stored.

    ``pairs`` has u, v and more columns; ``texts`` has _row, text and its size
    in bytes, with row numbers from 0; ``rows`` gives the row of each node
    (none: nodes are rows).  Pairs gather by the smallest partner v of their u;
    a partner with very many, or very long ones, is salted into several groups,
    and a text goes only to the groups that need it.  Pairs of one u always
    share a group, so u must be the side with few.
    """
    pairs = stored(pairs, "pairs")
    sizes = texts.select("_row", "size")
    sizes = rows.join(sizes.hint("shuffle_hash"), "_row").select("node", "size") if rows is not None else sizes.withColumnRenamed("_row", "node")
    total = pairs.count()

    def with_size(ends: DataFrame, name: str) -> DataFrame:
        return ends.join(sizes.select(F.col("node").alias(name), F.coalesce("size", F.lit(0)).alias(f"{name}_size")).hint("shuffle_hash"), name)

    # what grows with the corpus is never broadcast, and a partner of very many is no hot key
    partners = stored(with_size(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v"), "partners")
    own = spread_join(pairs.select("u", "v"), partners, ["v"], "n", total).groupBy("u").agg(F.min("v").alias("a"), F.sum("v_size").alias("others"))
    anchors = stored(with_size(own, "u").select("u", "a", (F.col("u_size") + F.col("others")).alias("bytes")), "anchors")
    n, volume = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    groups = max(1, n // group, volume // GROUP_BYTES)
    parts = 1 + F.greatest(F.floor(F.count(F.lit(1)) / max(1, group // 2)), F.floor(F.sum("bytes") / GROUP_BYTES))
    width = stored(anchors.groupBy("a").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n")), "width")
    salt = F.pmod(F.xxhash64("u"), F.col("parts"))
    placed = spread_join(anchors, width, ["a"], "n", n).select("u", F.pmod(F.xxhash64("a", salt), F.lit(groups)).alias("g"))
    placed = stored(pairs.join(placed, "u"), "placed")
    need = placed.select("g", F.col("u").alias("node")).union(placed.select("g", F.col("v").alias("node"))).distinct()
    need = need.join(rows, "node") if rows is not None else need.withColumn("_row", F.col("node"))
    need = stored(need.select("g", "node", "_row"), "need")
    left = texts.select("_row", "text").join(need.where(F.col("_row") > -1).hint("shuffle_hash"), "_row").select("g", "node", "text").groupBy("g")
    right = placed.withColumnRenamed("g", "own_g").groupBy("own_g")
    with runtime_filter(pairs.sparkSession):
        met = stored(left.cogroup(right).applyInArrow(look, schema), "met")
    for done in (pairs, partners, anchors, width, placed, need):
        drop_stored(done)
    return met


def few_first(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) turned so that u is in fewer pairs than v, or in as many and greater."""
    pairs = stored(pairs.select("u", "v").distinct(), "turned")
    degree = stored(pairs.select("u").union(pairs.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("d")), "degrees")
    total = pairs.count()
    both = spread_join(pairs, degree.withColumnRenamed("d", "du"), ["u"], "du", total)
    both = spread_join(both, degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), ["v"], "dv", total)
    turn = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return both.select(F.when(turn, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turn, F.col("u")).otherwise(F.col("v")).alias("v"))
