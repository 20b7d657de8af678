"""SQL statements on definitions, sessions and prepared texts that Spark SQL lacks or limits.

Changes that a Parquet table cannot take in place (dropping, renaming or
retyping a column) write the table anew beside the old one and swap them; its
partitioning and properties are kept.  UPSERT rewrites the files it touches.  What no Spark table has
(NOT NULL on an existing column, owners, grants, branches) is an error that
says so.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError
from sluice.sources import touched
from sluice.sources.sinks import KEY_PROPERTY, properties, replace_table, set_properties

if TYPE_CHECKING:
    from sluice.engine import Engine

_FLAGS = re.IGNORECASE | re.DOTALL
_ALTER = re.compile(r"alter\s+table\s+(if\s+exists\s+)?([\w.`]+)\s+(.*)$", _FLAGS)
_ADD = re.compile(r"add\s+(?:column\s+)?(if\s+not\s+exists\s+)?(?!columns\b|partition\b|constraint\b|\()(\w+)\s+(.*)$", _FLAGS)
_DROP = re.compile(r"drop\s+(?:column\s+)?(if\s+exists\s+)?(?!columns\b|partition\b|constraint\b)(\w+)$", _FLAGS)
_RENAME = re.compile(r"rename\s+column\s+(if\s+exists\s+)?(\w+)\s+to\s+(\w+)$", _FLAGS)
_RETYPE = re.compile(r"alter\s+(?:column\s+)?(\w+)\s+(?:set\s+data\s+)?type\s+(.+)$", _FLAGS)
_NOT_NULL = re.compile(r"alter\s+(?:column\s+)?(\w+)\s+(set|drop)\s+not\s+null$", _FLAGS)
_PROPERTIES = re.compile(r"set\s+properties\s+(.*)$", _FLAGS)
_UPSERT = re.compile(r"upsert\s+into\s+([\w.`]+)(?:\s*\(([\w\s,]+)\))?\s+(.*)$", _FLAGS)
_SET = re.compile(r"set\s+session\s+([\w.]+)\s*=\s*(.*)$", _FLAGS)
_RESET = re.compile(r"reset\s+session\s+([\w.]+)$", _FLAGS)
_DESCRIBE = re.compile(r"describe\s+(input|output)\s+(\w+)$", _FLAGS)
_STATS = re.compile(r"show\s+stats\s+for\s+(.*)$", _FLAGS)
_SHOW_VIEW = re.compile(r"show\s+create\s+(?:materialized\s+)?view\s+([\w.`]+)$", _FLAGS)
_SHOW_SCHEMA = re.compile(r"show\s+create\s+schema\s+([\w.`]+)$", _FLAGS)
_NOT_HERE = re.compile(r"(show\s+(?:grants|roles|branches)|alter\s+table\s+\S+\s+(?:set\s+authorization|execute))\b", _FLAGS)


def run_admin(engine: Engine, text: str) -> DataFrame | None:
    """The result of a statement that is handled here; None for any other."""
    if m := _NOT_HERE.match(text):
        raise FlowError(f"Spark has nothing for {m[1]!r}")
    if m := _ALTER.match(text):
        return _altered(engine, m[2], bool(m[1]), m[3].strip())
    if m := _UPSERT.match(text):
        return upsert(engine, m[1], [c.strip() for c in m[2].split(",")] if m[2] else None, m[3])
    if m := _SET.match(text):
        engine.spark.conf.set(m[1], str(_value(engine, m[2])))
        return _said(engine, "set")
    if m := _RESET.match(text):
        engine.spark.conf.unset(m[1])
        return _said(engine, "reset")
    if re.match(r"show\s+session$", text, _FLAGS):
        return engine.spark.sql("set").select(F.col("key").alias("name"), "value")
    if m := _DESCRIBE.match(text):
        return _described(engine, m[1].lower(), m[2])
    if m := _STATS.match(text):
        inner = m[1].strip()
        return table_stats(engine.sql(inner[1:-1] if inner.startswith("(") else f"select * from {inner}"))
    if m := _SHOW_VIEW.match(text):
        return engine.spark.sql(f"show create table {m[1]}")
    if m := _SHOW_SCHEMA.match(text):
        found = engine.spark.catalog.getDatabase(m[1])
        return engine.spark.createDataFrame([(f"CREATE SCHEMA {found.name} LOCATION '{found.locationUri}'",)], "create_schema string")
    return None


def _said(engine: Engine, what: str) -> DataFrame:
    return engine.spark.createDataFrame([(what,)], "result string")


def _value(engine: Engine, text: str):
    """A constant's value; a bare word stands for itself."""
    return text.strip() if re.fullmatch(r"\s*[A-Za-z_][\w.]*\s*", text) else engine.spark.sql(f"select {text} as v").first().v


def _column(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def _altered(engine: Engine, table: str, if_exists: bool, change: str) -> DataFrame | None:
    from sluice.sql_front import shielded, spark_dialect, split_list, unshielded

    spark = engine.spark
    if not spark.catalog.tableExists(table):
        if if_exists:
            return _said(engine, "nothing to alter")
        raise FlowError(f"no table {table}")
    old = spark.table(table)

    def known(name: str, optional: str | None) -> str | None:
        found = _column(old, name)
        if found is None and not optional:
            raise FlowError(f"{table} has no column {name}")
        return found

    if m := _RENAME.match(change):
        if name := known(m[2], m[1]):
            if _column(old, m[3]) not in (None, name):
                raise FlowError(f"{table} has a column {m[3]} already")
            replace_table(spark, table, old.withColumnRenamed(name, m[3]), {name: m[3]})
    elif m := _ADD.match(change):
        if _column(old, m[2]) is None:
            spark.sql(f"alter table {table} add column {m[2]} {spark_dialect(m[3])}")
        elif not m[1]:
            raise FlowError(f"{table} has a column {m[2]} already")
    elif m := _DROP.match(change):
        if name := known(m[2], m[1]):
            if len(old.columns) == 1:
                raise FlowError(f"{name} is the only column of {table}")
            if name.lower() in properties(spark, table).get(KEY_PROPERTY, "").lower().split(","):
                raise FlowError(f"{name} is part of the key of {table}")
            replace_table(spark, table, old.drop(name))
    elif m := _RETYPE.match(change):
        name = known(m[1], None)
        replace_table(spark, table, old.withColumn(name, F.col(f"`{name}`").cast(spark_dialect(m[2]).strip())))
    elif m := _NOT_NULL.match(change):
        known(m[1], None)
        if m[2].lower() == "set":
            raise FlowError("columns of Spark tables can be null; filter the nulls or save a new table")
    elif m := _PROPERTIES.match(change):
        text, kept = shielded(m[1])
        pairs = [p.split("=", 1) for p in split_list(text)]
        set_properties(spark, table, {k.strip(): str(_value(engine, unshielded(v, kept))) for k, v in pairs})
    else:
        spark.sql(f"alter table {table} {spark_dialect(change)}")
    return _said(engine, "altered")


def upsert(engine: Engine, table: str, columns: list[str] | None, query: str) -> DataFrame:
    """Rows of the query replace the rows with their key and are added where there is none.

    The key is the table's property ``primary_key``.  Columns that the
    statement leaves out keep their value, and are null in added rows; two
    query rows of one key are an error, as either could win.  Null keys match
    each other.
    """
    spark = engine.spark
    old = spark.table(table)
    named = properties(spark, table).get(KEY_PROPERTY)
    if not named:
        raise FlowError(f"upsert: set the key first: alter table {table} set properties {KEY_PROPERTY} = 'column, ...'")
    keys = [_column(old, k.strip()) or k.strip() for k in named.split(",")]
    given = [_column(old, c) or c for c in columns] if columns else old.columns
    if unknown := [c for c in (*given, *keys) if c not in old.columns]:
        raise FlowError(f"{table} has no column {unknown[0]}")
    if missing := [k for k in keys if k not in given]:
        raise FlowError(f"upsert: the key column {missing[0]} is not given")
    source = engine.sql(query)
    if len(source.columns) != len(given):
        raise FlowError(f"upsert: {len(source.columns)} columns into {len(given)}")
    new = source.toDF(*given).select(*[F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in given])
    if new.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("sl_n")).where("sl_n > 1").limit(1).count():
        raise FlowError("upsert: the query has two rows of one key")
    rows = touched.numbered(spark, table).alias("o")
    known = rows.join(new.alias("n"), reduce(Column.__and__, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]))
    values = [F.col(f"n.`{c}`" if c in given else f"o.`{c}`").alias(f"_new_{c}") for c in old.columns]
    acted = known.select(touched.FILE, touched.ROW, F.lit(False).alias("_gone"), *values)
    rest = new.alias("n").join(rows, reduce(Column.__and__, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]), "left_anti")
    added = rest.select(*[F.col(c) if c in given else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    touched.apply(spark, table, acted, added)
    return _said(engine, "upserted")


def _described(engine: Engine, what: str, name: str) -> DataFrame:
    """Parameters (position, type) or columns (column_name, type) of a prepared statement, which is not run."""
    from sluice.sql_front import shielded

    if name not in engine._prepared:
        raise FlowError(f"no prepared statement {name}")
    text = engine._prepared[name]
    marks = shielded(text)[0].count("?")
    if what == "input":
        return engine.spark.createDataFrame([(i, "unknown") for i in range(marks)], "position int, type string")
    if not re.match(r"\(*\s*(select|with|values|from|table|show|describe)\b", text.strip(), re.IGNORECASE):
        return engine.spark.createDataFrame([], "column_name string, type string")
    df = engine.sql(text, [None] * marks) if marks else engine.sql(text)
    return engine.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, type string")


def table_stats(df: DataFrame) -> DataFrame:
    """A row per column in one pass: estimated distinct values, share of nulls, least and greatest; a last row has the row count."""
    plain = T.AtomicType

    def facts(i: int, f: T.StructField) -> list[Column]:
        x = F.col(f"`{f.name}`")
        ordered = isinstance(f.dataType, plain) and not isinstance(f.dataType, (T.BinaryType, T.BooleanType))
        ends = [F.min(x).cast("string"), F.max(x).cast("string")] if ordered else [F.lit(None).cast("string")] * 2
        distinct = F.approx_count_distinct(x) if isinstance(f.dataType, plain) else F.lit(None).cast("long")
        return [distinct.alias(f"d{i}"), F.count(x).alias(f"n{i}"), ends[0].alias(f"lo{i}"), ends[1].alias(f"hi{i}")]

    cells = [c for i, f in enumerate(df.schema) for c in facts(i, f)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"d{i}").cast("double").alias("distinct_values_count"), F.when(F.col("n") > 0, 1 - F.col(f"n{i}") / F.col("n")).alias("nulls_fraction"), none.alias("row_count"), F.col(f"lo{i}").alias("low_value"), F.col(f"hi{i}").alias("high_value"))
        for i, f in enumerate(df.schema)
    ]
    entries.append(F.struct(text.alias("column_name"), none.alias("distinct_values_count"), none.alias("nulls_fraction"), F.col("n").cast("double").alias("row_count"), text.alias("low_value"), text.alias("high_value")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
