"""Changes of single rows that rewrite only the files that hold them.

Every row of a Parquet table is known by its file and its position there.  A
change gives those of the rows that it acts on; files without such a row are
left as they are.  New files are written to a hidden folder beside the old ones,
and a journal lists which of them come and which old ones go.  From the moment
the journal is there the change holds: if the driver dies while files are moved,
the next change of the table (or :func:`recover`) finishes it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import sinks

FILE, ROW = "_file", "_row"
_JOURNAL, _STAGED = "_change-", "_staged-"


def numbered(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows with their file and position; a table of another format becomes Parquet first."""
    recover(spark, table)
    try:
        return _with_places(spark.table(table))
    except AnalysisException:
        sinks.replace_table(spark, table, spark.table(table))
        return _with_places(spark.table(table))


def _with_places(df: DataFrame) -> DataFrame:
    out = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    assert out.schema
    return out


def apply(spark: SparkSession, table: str, acted: DataFrame | None, added: DataFrame | None = None) -> None:
    """Change the ``acted`` rows (file, row, _gone and, for updates, ``_new_`` columns), none twice, and add rows."""
    old = spark.table(table)
    files = sorted(r[0] for r in acted.select(FILE).distinct().collect()) if acted is not None else []
    parted = any(c.isPartition for c in spark.catalog.listColumns(table))
    if parted and (files or added is not None):
        parts = [_content(numbered(spark, table), acted, old) if acted is not None else old, *([added] if added is not None else [])]
        sinks.replace_table(spark, table, reduce(DataFrame.unionByName, parts))
        return
    if not files:
        if added is not None:
            sinks.append_table(added, table)
        return
    rows = numbered(spark, table)
    content = _content(rows.where(rows[FILE].isin(files)), acted, old)
    rewrite(spark, files, content if added is None else content.unionByName(added))
    spark.catalog.refreshTable(table)


def _content(rows: DataFrame, acted: DataFrame, old: DataFrame) -> DataFrame:
    """The rows after the change."""
    change = acted.withColumnsRenamed({FILE: "_of_file", ROW: "_of_row"})
    both = rows.join(change, (rows[FILE] == change["_of_file"]) & (rows[ROW] == change["_of_row"]), "left")

    def value(name: str) -> Column:
        new = f"_new_{name}"
        return F.when(F.col("_of_row").isNotNull(), F.col(f"`{new}`")).otherwise(F.col(f"`{name}`")).alias(name) if new in change.columns else F.col(f"`{name}`")

    return both.where(~F.coalesce("_gone", F.lit(False))).select(*[value(c) for c in old.columns])


def rewrite(spark: SparkSession, files: list[str], content: DataFrame) -> None:
    """Put ``content`` in the place of files of one folder, of which it may read."""
    folder = files[0].rsplit("/", 1)[0]
    change = uuid.uuid4().hex
    staged = f"{folder}/{_STAGED}{change}"
    content.write.parquet(staged)
    fs, at = sinks._fs(spark, staged)
    new = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
    lines = [f"add {_STAGED}{change}/{n} {change}-{n}" for n in new] + [f"drop {_named(spark, f)}" for f in files]
    path = _path(spark, f"{folder}/{_JOURNAL}{change}")
    beside = _path(spark, f"{folder}/_writing-{change}")
    out = fs.create(beside, True)
    out.write("\n".join(lines).encode())
    out.close()
    fs.rename(beside, path)
    _finish(spark, path)


def _path(spark: SparkSession, text: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)


def _named(spark: SparkSession, file: str) -> str:
    """A file's own name; paths of rows are written as URIs."""
    return _path(spark, spark.sparkContext._jvm.java.net.URI(file).getPath()).getName()


def _finish(spark: SparkSession, journal) -> None:
    """Carry out a journal; each step may have been done before."""
    fs = journal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = fs.open(journal)
    text = bytes(source.readAllBytes()).decode()
    source.close()
    folder = journal.getParent()
    steps = [line.split(" ") for line in text.split("\n") if line]
    sub = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)
    for step in steps:
        if step[0] == "add" and fs.exists(sub(step[1])) and not fs.rename(sub(step[1]), sub(step[2])):
            raise OSError(f"cannot move {step[1]}")
    for step in steps:
        if step[0] == "drop":
            fs.delete(sub(step[1]), False)
    fs.delete(sub(journal.getName().replace(_JOURNAL, _STAGED)), True)
    fs.delete(journal, False)


def recover(spark: SparkSession, table: str) -> None:
    """Finish changes that were broken off, and drop what was written for ones that never held."""
    location = next((r.data_type for r in spark.sql(f"describe formatted {table}").collect() if r.col_name == "Location"), None)
    if not location:
        return
    fs, folder = sinks._fs(spark, location)
    if not fs.exists(folder):
        return
    names = [f.getPath() for f in fs.listStatus(folder)]
    journals = [p for p in names if p.getName().startswith(_JOURNAL)]
    for p in journals:
        _finish(spark, p)
    if journals:
        spark.catalog.refreshTable(table)
