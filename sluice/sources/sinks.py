"""Saving, appending and deleting: tables of the catalog and files.

Files and tables are never overwritten while they are read: new content is
written beside the old and then takes its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import FlowError
from sluice.sources import files

_WRITER_OPTIONS = {"compression", "sep", "header", "partition_by", "single_file"}
#: The table property that names the key columns of UPSERT, comma-joined.
KEY_PROPERTY = "primary_key"


def save_table(df: DataFrame, name: str, options: dict[str, Any] | None = None) -> None:
    """Create or replace a table, also one that ``df`` reads."""
    spark = df.sparkSession
    beside = f"{name}_{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    if by := (options or {}).get("partition_by"):
        writer = writer.partitionBy(*by.split(","))
    with _partitions_that_move(spark):
        writer.saveAsTable(beside)
    # the old table is moved aside first and dropped last, so a crash in between loses neither
    aside = f"{name}_{uuid.uuid4().hex[:8]}"
    if spark.catalog.tableExists(name):
        if _in_memory(spark) and any(c.isPartition for c in spark.catalog.listColumns(name)):
            # that catalog would later drop the partitions at their old places, where the new ones are then
            spark.sql(f"drop table {name}")
        else:
            spark.sql(f"alter table {name} rename to {aside}")
    spark.sql(f"alter table {beside} rename to {name}")
    spark.sql(f"drop table if exists {aside}")


def _in_memory(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.catalogImplementation") == "in-memory"


@contextmanager
def _partitions_that_move(spark: SparkSession) -> Iterator[None]:
    """Tables made inside find their partitions by listing, where the catalog is in memory.

    That catalog keeps the old places of a renamed table's partitions, which
    would then be empty; a metastore moves them along.
    """
    option = "spark.sql.hive.manageFilesourcePartitions"
    if not _in_memory(spark):
        yield
        return
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"show tblproperties {table}").collect() if not r.key.startswith(("transient", "spark.sql."))}


def replace_table(spark: SparkSession, table: str, df: DataFrame, renamed: dict[str, str] | None = None) -> None:
    """Put ``df`` in the table's place; its partition columns and properties stay."""
    renamed = renamed or {}
    parts = [renamed.get(c.name, c.name) for c in spark.catalog.listColumns(table) if c.isPartition]
    parts = [c for c in parts if c in df.columns]
    kept = properties(spark, table)
    if KEY_PROPERTY in kept:
        kept[KEY_PROPERTY] = ",".join(renamed.get(c, c) for c in kept[KEY_PROPERTY].split(","))
    save_table(df, table, {"partition_by": ",".join(parts)} if parts else None)
    set_properties(spark, table, kept)


def set_properties(spark: SparkSession, table: str, values: dict[str, str]) -> None:
    if values:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in values.items())
        spark.sql(f"alter table {table} set tblproperties ({pairs})")


def _quoted(text: str) -> str:
    escaped = str(text).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def append_table(df: DataFrame, name: str, columns: tuple[str, ...] = ()) -> None:
    """Insert by position, or into the named columns; a missing table is created."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        (df.toDF(*columns) if columns else df).write.saveAsTable(name)
        return
    target = spark.table(name).columns
    if columns:
        named = df.toDF(*columns)
        missing = [c for c in target if c not in columns]
        df = named.select(*columns, *[_null(spark.table(name), c) for c in missing]).select(*target)
    elif len(df.columns) != len(target):
        raise FlowError(f"append: {len(df.columns)} columns into {len(target)}")
    df.write.insertInto(name)


def _null(table: DataFrame, name: str):
    return F.lit(None).cast(table.schema[name].dataType).alias(name)


def save_file(df: DataFrame, path: str, options: dict[str, Any] | None = None) -> None:
    """Write by extension: parquet, csv, tsv, json (lines), orc.

    The path becomes a folder of part files, which the sources read back as
    one; ``single_file: true`` makes one part, for small results.
    """
    spark = df.sparkSession
    options = dict(options or {})
    if options.pop("single_file", False):
        df = df.coalesce(1)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    kind = files.kind_of(path)
    writer = df.write
    if by := options.pop("partition_by", None):
        writer = writer.partitionBy(*by.split(","))
    for k, v in options.items():
        if k in _WRITER_OPTIONS:
            writer = writer.option(k, v)
    if path.endswith(".gz"):
        writer = writer.option("compression", "gzip")
    if kind in ("csv", "tsv"):
        writer.option("header", options.get("header", True)).option("sep", "\t" if kind == "tsv" else ",").csv(beside)
    elif kind in ("json", "jsonl", "ndjson"):
        writer.option("ignoreNullFields", False).json(beside)
    elif kind in ("parquet", "orc"):
        getattr(writer, kind)(beside)
    else:
        raise FlowError(f"no writer for {path}")
    swap(spark, beside, path)


def append_file(df: DataFrame, path: str) -> None:
    """Add rows to a file, which is created if missing; a folder of part files only gains parts."""
    spark = df.sparkSession
    if not exists(spark, path):
        save_file(df, path)
        return
    old = files.read(spark, path)
    if len(old.columns) != len(df.columns):
        raise FlowError(f"append: {len(df.columns)} columns into {len(old.columns)}")
    fs, target = _fs(spark, path)
    if files.kind_of(path) == "parquet" and fs.getFileStatus(target).isDirectory():
        added = df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, old.schema, strict=True)])
        if added.columns == old.columns and len({c.lower() for c in df.columns}) == len(df.columns):
            added.write.mode("append").parquet(path)
            return
    save_file(old.union(df), path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a written folder in the place of another, which is moved aside first and deleted last."""
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.old")[1]
    held = fs.exists(target)
    if held and not fs.rename(target, aside):
        raise FlowError(f"cannot move {path} aside")
    if not fs.rename(_fs(spark, new)[1], target):
        if held:
            fs.rename(aside, target)
        raise FlowError(f"cannot move {new} to {path}")
    if held:
        fs.delete(aside, True)
