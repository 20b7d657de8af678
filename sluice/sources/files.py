"""File sources by extension."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import FlowError

REMOTE = ("s3://", "s3a://", "https://", "http://", "hdfs://", "file:", "viewfs://", "gs://", "abfss://")


def located(path: str, base: str | None) -> str:
    """The path for Spark's reader: remote ones pass, others are relative to ``base``."""
    if path.startswith("s3://"):
        return "s3a://" + path[5:]
    if path.startswith(REMOTE) or os.path.isabs(path) or not base:
        return path
    return f"{base.rstrip('/')}/{path}"


def kind_of(path: str) -> str:
    name = path.lower().rstrip("/")
    for ending in (".gz", ".bz2", ".zst", ".snappy"):
        name = name.removesuffix(ending)
    for kind in ("parquet", "csv", "tsv", "json", "jsonl", "ndjson", "orc", "txt", "wv", "sql", "avro"):
        if name.endswith("." + kind):
            return kind
    raise FlowError(f"no reader for {path}")


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
        return df.select(*[F.col(f"`{f.name}`").cast("bigint") if f.dataType.simpleString() == "int" else F.col(f"`{f.name}`") for f in df.schema])
    if kind == "txt":
        return spark.read.text(path)
    if kind in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, lines=kind != "json")
    raise FlowError(f"no reader for {path}")


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """JSON lines or one array; columns in the order of the first record's keys.

    Spark sorts inferred columns by name; the first record restores the order.
    """
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    first = head[0][0].strip() if head else ""
    as_lines = lines or (first.startswith("{") and first.endswith("}"))
    df = spark.read.option("multiLine", not as_lines).json(path)
    order = first_keys(spark, path, first if as_lines else None)
    known = {c: c for c in df.columns}
    names = [c for c in order if c in known] + [c for c in df.columns if c not in order]
    return df.select(*[F.col(f"`{c}`") for c in names])


def first_keys(spark: SparkSession, path: str, line: str | None) -> list[str]:
    """The keys of the first record, in order."""
    if line is None:
        row = spark.read.option("wholetext", True).text(path).select(F.substring("value", 1, 1 << 20)).limit(1).collect()
        line = row[0][0] if row else ""
    start = line.find("{")
    if start < 0:
        return []
    try:
        return list(json.JSONDecoder().raw_decode(line, start)[0])
    except ValueError:
        return []
