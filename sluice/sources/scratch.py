"""Intermediate rows in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.sources import sinks

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local master may use this machine's temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="sluice-"))
    path = f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"
    fs, at = sinks._fs(spark, path)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again, so that nothing above is computed twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
