"""Subscriptions to a model, on Structured Streaming.

``subscribe`` turns a file-backed relation into an incremental query: new rows
since the last run, appended to a target, with a watermark on the time column.
``windowed`` and ``sessions`` are windowed aggregations over a stream;
``run_updates`` keeps aggregates up to date by what each batch changes,
``interval_join`` joins two streams within a time bound, and ``split_late``
keeps late rows apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError
from sluice.sources import sinks


def duration(text: str) -> str:
    """'1h', '30m', '10s', '2d' or Spark's own spelling."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text)
    if not m:
        return text
    return f"{m[1]} " + {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[m[2]]


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``df`` with a watermark; a time without zone is taken as UTC, as watermarks need an instant."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp_ntz":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    elif kind in ("bigint", "int"):
        df = df.withColumn(column, F.timestamp_seconds(column))
    elif kind != "timestamp":
        raise FlowError(f"{column} is no time: {kind}")
    return df.withWatermark(column, duration(delay))


def as_stream(df: DataFrame) -> DataFrame:
    """The files behind a scan as a stream of the same columns."""
    paths = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    names = sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())
    if len(paths) != 1:
        raise FlowError("a subscription needs one folder of files")
    reader = df.sparkSession.readStream.schema(df.schema)
    if len(names) == 1:
        reader = reader.option("pathGlobFilter", names[0])
    return reader.parquet(paths[0])


def run_available(stream: DataFrame, checkpoint: str, target: str, mode: str = "append") -> DataFrame:
    """Run the stream over all available input into Parquet files at ``target``; the files so far."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _folders(spark: SparkSession, target: str, kind: str) -> dict[int, str]:
    """Finished folders ``kind=number`` under a target."""
    fs, at = sinks._fs(spark, target)
    if not fs.exists(at):
        return {}
    out = {}
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if re.fullmatch(rf"{kind}=\d+", name) and sinks.exists(spark, f"{target}/{name}/_SUCCESS"):
            out[int(name.split("=")[1])] = f"{target}/{name}"
    return out


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = sinks._fs(spark, path)
    fs.delete(at, True)


def _run(stream: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, target: str) -> DataFrame:
    """Run a stream of aggregates to the end of its input; its last complete table, as Parquet under ``target``.

    Every batch's whole table is written by the executors to a folder of its
    own, so nothing gathers on the driver and a batch that runs again writes
    the same folder.  A run without new input gives the table of the last one.
    """
    spark = stream.sparkSession
    _run(stream, "complete", f"{target}-checkpoint", lambda batch, no: batch.write.mode("overwrite").parquet(f"{target}/batch={no}"))
    done = _folders(spark, target, "batch")
    for no in sorted(done)[:-1]:
        _drop(spark, done[no])
    return spark.read.schema(stream.schema).parquet(done[max(done)]) if done else spark.createDataFrame([], stream.schema)


#: Batches whose changes are read together before they are put into one base.
COMPACT = 16


def run_updates(stream: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Run a stream of aggregates to the end of its input, writing only what changed; the aggregates of all keys so far.

    Spark's state holds the partial aggregates of each key and merges a batch
    into them.  A batch gives the keys that it changed, written to a folder
    under its number, so a batch that runs again changes nothing.  A key's row
    is the one of its latest batch; from time to time the latest rows become a
    base and the folders before it go.
    """
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, no: int) -> None:
        if no > max(_folders(spark, target, "base"), default=-1):
            batch.withColumn("_batch", F.lit(no).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={no}")

    _run(stream, "update", f"{target}-checkpoint", write)
    base, batches = _folders(spark, target, "base"), _folders(spark, target, "batch")
    start = max(base, default=-1)
    parts = [base[start]] if base else []
    parts += [path for no, path in sorted(batches.items()) if no > start]

    def latest() -> DataFrame:
        rows = spark.read.schema(schema).parquet(*parts)
        newest = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in schema.names]), "_batch").alias("row"))
        return newest.select("row.*")

    if not parts:
        return spark.createDataFrame([], stream.schema)
    if len(parts) > COMPACT:
        end = max(batches)
        latest().write.mode("overwrite").parquet(f"{target}/base={end}")
        for path in parts:
            _drop(spark, path)
        parts = [f"{target}/base={end}"]
    return latest().drop("_batch")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: str, after: str, delay: str = "0 seconds") -> DataFrame:
    """Pairs of equal keys whose right time lies within ``before`` and ``after`` the left time, as a stream.

    Both sides have watermarks, so Spark drops rows from its state once no
    later row can meet them.  Columns of both sides, the keys once; names other
    than the keys must differ.
    """
    l, r = with_event_time(left, left_time, delay), with_event_time(right, right_time, delay)
    r = r.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k) == F.col(f"_right_{k}") for k in keys])
    low, high = (F.expr(f"interval {duration(x)}") for x in (before, after))
    on = on & (F.col(right_time) >= F.col(left_time) - low) & (F.col(right_time) <= F.col(left_time) + high)
    return l.join(r, on).drop(*[f"_right_{k}" for k in keys])


def split_late(stream: DataFrame, time: str, delay: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream to the end of its input; its rows in time, and those that came too late.

    A row is late if its time is before the greatest time of earlier batches
    less ``delay``.  Late rows are kept in a folder of their own instead of
    being dropped, each with its batch; a batch that runs again finds the same
    limit and writes the same rows.
    """
    spark = stream.sparkSession
    marks = T.StructType([T.StructField("upto", T.TimestampType())])
    rows = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, no: int) -> None:
        seen = [path for n, path in _folders(spark, f"{target}/marks", "batch").items() if n < no]
        limit = spark.read.schema(marks).parquet(*seen).agg(F.max("upto")).first()[0] if seen else None
        instant = F.col(time).cast("timestamp")
        late = F.coalesce(instant < F.lit(limit) - F.expr(f"interval {duration(delay)}"), F.lit(False)) if limit else F.lit(False)
        told = batch.withColumn("batch", F.lit(no).cast("long")).withColumn("_late", late).persist()
        for name, kept in (("rows", ~F.col("_late")), ("late", F.col("_late"))):
            told.where(kept).drop("_late").write.mode("overwrite").parquet(f"{target}/{name}/batch={no}")
        told.agg(F.max(instant).alias("upto")).write.mode("overwrite").parquet(f"{target}/marks/batch={no}")
        told.unpersist()

    _run(stream, "append", f"{target}-checkpoint", write)

    def read(name: str) -> DataFrame:
        found = list(_folders(spark, f"{target}/{name}", "batch").values())
        return spark.read.schema(rows).parquet(*found) if found else spark.createDataFrame([], rows)

    return read("rows"), read("late")


def subscribe(df: DataFrame, watermark_column: str | None = None, window_size: str | None = None, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """New rows of a stream since the last call with the same ``checkpoint``.

    ``df`` is a stream with its operators, or a plain scan of files.  Without a checkpoint every call starts anew and gives all rows; with one,
    rows are appended to ``target`` exactly once and the files so far are
    returned.
    """
    if checkpoint is None or target is None:
        return with_event_time(df, watermark_column, window_size or "0 seconds") if watermark_column else df
    stream = df if df.isStreaming else as_stream(df)
    if watermark_column:
        stream = with_event_time(stream, watermark_column, window_size or "0 seconds")
    return run_available(stream, checkpoint, target)


def windowed(stream: DataFrame, time: str, size: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows: window_start, window_end, keys, aggregates."""
    marked = with_event_time(stream, time, delay)
    w = F.window(time, duration(size), duration(slide)) if slide else F.window(time, duration(size))
    out = marked.groupBy(w.alias("w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, time: str, gap: str, aggregates: list[Column], keys: list[str] | None = None, delay: str = "0 seconds") -> DataFrame:
    """Session windows: a session ends after ``gap`` without a row."""
    marked = with_event_time(stream, time, delay)
    out = marked.groupBy(F.session_window(time, duration(gap)).alias("w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return with_event_time(stream, time, delay).dropDuplicatesWithinWatermark(keys)
