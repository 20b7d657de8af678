"""Catalog listings as relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import FlowError

SCHEMAS = {
    "tables": "name string",
    "schemas": "catalog string, name string",
    "databases": "name string",
    "catalogs": "name string",
    "models": "name string, args string, package_name string",
    "functions": "name string, kind string",
    "columns": "table_name string, column_name string, column_type string",
}

#: Names of temporary views by which SQL text sees an engine's tables; another engine's folder goes before them.
sql_views: set[str] = set()


def show(spark: SparkSession, what: str, where: str | None, models: Iterable[tuple[str, str, str]], tables: Iterable[str]) -> DataFrame:
    """``show what [in where]``; ``tables`` are those known to the session besides the catalog's."""
    cat = spark.catalog
    if what == "tables":
        rows = [(t.name,) for t in cat.listTables(where)] + [(t,) for t in tables]
    elif what in ("schemas", "databases"):
        names = sorted(d.name for d in cat.listDatabases())
        rows = [(cat.currentCatalog(), n) for n in names] if what == "schemas" else [(n,) for n in names]
    elif what == "catalogs":
        rows = [(c.name,) for c in cat.listCatalogs()]
    elif what == "models":
        rows = list(models)
    elif what == "functions":
        rows = [(f.name, "temporary" if f.isTemporary else "builtin") for f in cat.listFunctions()]
    elif what == "columns":
        names = [where] if where else [t.name for t in cat.listTables()]
        rows = [(n, c.name, c.dataType) for n in names for c in cat.listColumns(n)]
    else:
        raise FlowError(f"show {what} is not known")
    return spark.createDataFrame(sorted(set(rows)), SCHEMAS[what])


def wv_tables(spark: SparkSession) -> DataFrame:
    """All tables as (table_catalog, table_schema, table_name, table_type)."""
    cat = spark.catalog
    rows = [(t.catalog or cat.currentCatalog(), (t.namespace or [""])[0], t.name, t.tableType) for d in cat.listDatabases() for t in cat.listTables(d.name)]
    return spark.createDataFrame(sorted(set(rows)), "table_catalog string, table_schema string, table_name string, table_type string")


def wv_schemas(spark: SparkSession) -> DataFrame:
    rows = sorted((d.catalog or "", d.name) for d in spark.catalog.listDatabases())
    return spark.createDataFrame(rows, "catalog_name string, schema_name string")
