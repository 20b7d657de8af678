"""Sharding by sampled splitters, in DataFrame operations only.

1. Keys: the text's 64-bit hash, then the id's hash, so equal texts are
   neighbours and a text that very many rows share can still be divided.
2. A size-weighted sample of about ``SAMPLED`` keys a range: a row is drawn when its own
   hash, as a fraction, is below size * sample / total size.
3. Its quantiles are the splitters of ``ranges`` ranges.  A key that holds
   several quantiles is an overfull range and is subdivided by id hash.
4. Rows are dealt to their range; running sums inside a range and over the
   ranges' exact totals place each row on the axis of all bytes, and the shard
   is the sixteenth of that axis its middle falls into.  A group of equal texts
   smaller than ``1/GROUP_PART`` of a shard goes whole to the sixteenth of its
   own middle.

The sample only shapes the ranges, the placement is exact: shard sizes differ
from the mean by at most about one group or one document at each border.

Only (id, size, crc, hash) rows are shuffled, never texts; ranges are bounded
by the quantiles, so no key or source overfills a task.

Defined results: a null text has no bytes (size 1, crc of the empty string),
an empty text likewise; repeated rows each take a slot; null ids sort first;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import stored

SHARDS = 16
#: Expected number of sampled keys (16 bytes each go to the driver) of a range, ranges of a shard at least, and rows
#: of a range on average, up to MOST_RANGES of them.
SAMPLED, RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES = 32, 32, 1_000_000, 4096
#: A group of equal texts of more than this part of a shard is divided.
GROUP_PART = 64


def _splitters(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """Quantiles of the sorted sample; one whose key stands once begins at that key's first row."""
    cut = [sample[len(sample) * q // ranges] for q in range(1, ranges)] if sample else []
    keys = [k for k, _ in cut]
    low = -(1 << 63)
    return sorted({(k, sub if keys.count(k) > 1 else low) for k, sub in cut})


def _range_of(key: Column, sub: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below (key, sub), found in two levels of about the root of their count."""
    if not cuts:
        return F.lit(0)
    side = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + side] for i in range(0, len(cuts), side)]

    def pairs(part: list[tuple[int, int]]) -> str:
        return "array(" + ",".join(f"named_struct('k',{_long(k)},'s',{_long(s)})" for k, s in part) + ")"

    at = F.struct(key.alias("k"), sub.alias("s"))
    coarse = F.size(F.filter(F.expr(pairs([p[0] for p in parts])), lambda c: c <= at))
    nested = F.expr("array(" + ",".join(pairs(p) for p in parts) + ")")
    fine = F.size(F.filter(F.try_element_at(nested, coarse), lambda c: c <= at))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * side + fine).cast("int")


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, sample: int | None = None) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot, grown_shard, range.

    The law is ``bytes``: shard sizes are near equal.  ``slot`` counts a
    shard's rows from 0 in key order, without gaps.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(
        docs[id_col].alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("crc"),
        F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), docs[id_col]).alias("sub"),
    )
    slim = stored(slim, "keys")
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = ranges or max(shards * RANGES_PER_SHARD, min(MOST_RANGES, rows // RANGE_ROWS))
    sample = sample or SAMPLED * ranges
    fraction = F.shiftrightunsigned(F.xxhash64(F.lit(11), "key", "sub"), 11).cast("double") / float(1 << 53)
    drawn = slim.where(fraction * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(sample))).select("key", "sub")
    cuts = _splitters(sorted((r.key, r.sub) for r in drawn.collect()), ranges)
    dealt = slim.withColumn("range", _range_of(F.col("key"), F.col("sub"), cuts))

    totals = stored(dealt.groupBy("range").agg(F.sum("size").alias("bytes")), "ranges")
    before: dict[int, int] = {}
    run = 0
    for r in sorted(totals.collect()):  # at most len(cuts) + 1 rows
        before[r[0]] = run
        run += r[1]
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(list(before.items()) or [(0, 0)], "range int, start long"))

    in_range = Window.partitionBy("range").orderBy("key", "sub", "id")
    rows_so_far = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key")
    placed = dealt.join(starts, "range")
    placed = placed.withColumn("upto", F.sum("size").over(rows_so_far)).withColumn("held", F.sum("size").over(group)).withColumn("last", F.max("upto").over(group))
    whole = F.col("held") * (shards * GROUP_PART) <= F.lit(total)
    middle2 = F.when(whole, 2 * F.col("last") - F.col("held")).otherwise(2 * F.col("upto") - F.col("size")) + 2 * F.col("start")
    shard = F.least(F.lit(shards - 1), F.floor(middle2.cast("decimal(38,0)") * shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)"))).cast("int")
    placed = placed.withColumn("shard", shard)
    within = Window.partitionBy("range", "shard").orderBy("key", "sub", "id")
    placed = stored(placed.withColumn("no", F.row_number().over(within)).select("id", "size", "crc", "range", "shard", "no"), "placed")

    filled: list[tuple[int, int, int]] = []
    used = dict.fromkeys(range(shards), 0)
    for r in sorted(placed.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n")).collect()):  # bounded by the ranges
        filled.append((r.range, r.shard, used[r.shard]))
        used[r.shard] += r.n
    first = F.broadcast(spark.createDataFrame(filled or [(0, 0, 0)], "range int, shard int, first long"))
    return placed.join(first, ["range", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("no") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("range").alias("key_range"),
    )
