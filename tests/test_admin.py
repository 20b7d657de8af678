"""Statements on definitions and sessions, and tables of attached databases."""

import uuid

import pytest

from sluice import Engine
from sluice.errors import FlowError


@pytest.fixture
def engine(spark):
    return Engine(spark, "/root/testdata/sf0.001")


@pytest.fixture
def table(spark):
    name = f"adm_{uuid.uuid4().hex[:8]}"
    spark.sql(f"create table {name} using parquet partitioned by (p) as select * from values (1, 'a', 10), (2, 'b', 20), (3, null, 20) as t(id, s, p)")
    yield name
    spark.sql(f"drop table if exists {name}")


def rows(df):
    return sorted(([*r] for r in df.collect()), key=str)


def test_alter_table(engine, spark, table):
    engine.sql(f"alter table {table} add column if not exists n int")
    engine.sql(f"alter table {table} add column if not exists n int")
    assert spark.table(table).columns == ["id", "s", "n", "p"]
    with pytest.raises(FlowError, match="already"):
        engine.sql(f"alter table {table} add column s varchar")
    engine.sql(f"alter table {table} drop column n")
    engine.sql(f"alter table {table} drop column if exists n")
    with pytest.raises(FlowError, match="no column n"):
        engine.sql(f"alter table {table} drop column n")
    engine.sql(f"alter table {table} rename column id to key")
    with pytest.raises(FlowError, match="already"):
        engine.sql(f"alter table {table} rename column key to s")
    engine.sql(f"alter table {table} alter column key set data type varchar")
    assert rows(spark.table(table)) == [["1", "a", 10], ["2", "b", 20], ["3", None, 20]]
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["p"]
    engine.sql(f"alter table {table} alter column key drop not null")
    with pytest.raises(FlowError, match="can be null"):
        engine.sql(f"alter table {table} alter column key set not null")
    with pytest.raises(FlowError, match="Spark has nothing"):
        engine.sql(f"alter table {table} set authorization admin")
    assert rows(engine.sql("alter table if exists no_such_table drop column x")) == [["nothing to alter"]]
    with pytest.raises(FlowError, match="no table"):
        engine.sql("alter table no_such_table drop column x")


def test_a_renamed_partition_column_stays_one(engine, spark, table):
    engine.sql(f"alter table {table} rename column p to part")
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["part"]
    assert rows(spark.table(table).select("id", "part")) == [[1, 10], [2, 20], [3, 20]]


def test_upsert(engine, spark, table):
    with pytest.raises(FlowError, match="set the key"):
        engine.sql(f"upsert into {table} values (1, 'x', 1)")
    engine.sql(f"alter table {table} set properties primary_key = 'id', note = 'it''s'")
    engine.sql(f"upsert into {table} values (1, 'x', 11), (4, 'y', 40), (null, 'z', 0)")
    assert rows(spark.table(table)) == sorted([[1, "x", 11], [2, "b", 20], [3, None, 20], [4, "y", 40], [None, "z", 0]], key=str)
    engine.sql(f"upsert into {table} (id, s) select * from values (2, 'B'), (5, 'n'), (null, 'Z') as t(a, b)")
    assert rows(spark.table(table)) == sorted([[1, "x", 11], [2, "B", 20], [3, None, 20], [4, "y", 40], [5, "n", None], [None, "Z", 0]], key=str)
    with pytest.raises(FlowError, match="two rows of one key"):
        engine.sql(f"upsert into {table} (id, s) values (2, 'p'), (2, 'q')")
    with pytest.raises(FlowError, match="not given"):
        engine.sql(f"upsert into {table} (s) values ('p')")
    with pytest.raises(FlowError, match="part of the key"):
        engine.sql(f"alter table {table} drop column id")
    engine.sql(f"alter table {table} rename column id to k")
    engine.sql(f"upsert into {table} (k, s) values (3, 'c')")
    assert [3, "c", 20] in rows(spark.table(table))
    before = spark.table(table).count()
    engine.sql(f"upsert into {table} select * from {table} where false")
    assert spark.table(table).count() == before


def test_session_and_prepared(engine, spark):
    engine.sql("set session spark.sluice.probe = 'a''b'")
    assert spark.conf.get("spark.sluice.probe") == "a'b"
    assert ["spark.sluice.probe", "a'b"] in rows(engine.sql("show session"))
    engine.sql("reset session spark.sluice.probe")
    assert spark.conf.get("spark.sluice.probe", None) is None
    engine.sql("prepare p1 from select r_regionkey, r_name, '?' as mark from region where r_regionkey > ? and r_name <> ?")
    assert rows(engine.sql("describe input p1")) == [[0, "unknown"], [1, "unknown"]]
    assert [r[0] for r in engine.sql("describe output p1").collect()] == ["r_regionkey", "r_name", "mark"]
    with pytest.raises(FlowError, match="no prepared"):
        engine.sql("describe input p2")
    with pytest.raises(FlowError, match="Spark has nothing"):
        engine.sql("show grants on region")


def test_stats_and_definitions(engine, spark, table):
    stats = {r.column_name: r for r in engine.sql(f"show stats for {table}").collect()}
    assert (stats["id"].distinct_values_count, stats["id"].nulls_fraction, stats["id"].low_value, stats["id"].high_value) == (3.0, 0.0, "1", "3")
    assert abs(stats["s"].nulls_fraction - 1 / 3) < 1e-9 and stats[None].row_count == 3.0
    none = engine.sql(f"show stats for (select id, array(id) as a from {table} where id > 9)").collect()
    assert [(r.column_name, r.nulls_fraction, r.row_count) for r in none] == [("id", None, None), ("a", None, None), (None, None, 0.0)]
    engine.sql(f"create or replace view v_{table} as select id from {table}")
    assert f"v_{table}" in engine.sql(f"show create view v_{table}").first()[0]
    engine.sql(f"drop view v_{table}")
    assert engine.sql("show create schema default").first()[0].startswith("CREATE SCHEMA default LOCATION")


def test_attached_database(engine, spark):
    url = "jdbc:derby:memory:other;create=true"
    spark.sql("select id, cast(id * 2 as int) as v from range(100)").write.jdbc(url, "app.numbers", mode="overwrite")
    engine.attach("other", url, fetchsize=50)
    df = engine.query("from other.app.numbers where id >= 97 select id as k, v.sum over () as s")
    assert rows(df) == [[97, 588], [98, 588], [99, 588]]
    plan = engine.query("from other.app.numbers where id >= 97 select id as k")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThanOrEqual(id,97)]" in plan or "GreaterThanOrEqual(id,97)" in plan
    joined = engine.query("from other.numbers as n join region on n.id = r_regionkey select n.v, r_name")
    assert joined.count() == 5


def test_saving_over_a_partitioned_table_keeps_its_rows(engine, spark, table):
    for _ in range(2):
        engine.run(f"from {table} where id > 1 save to {table} with partition_by: 'p'")
        assert rows(spark.table(table)) == [[2, "b", 20], [3, None, 20]]
    engine.run(f"from {table} where id = 2 delete")
    assert rows(spark.table(table)) == [[3, None, 20]]
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["p"]
    engine.sql(f"update {table} set s = 'new' where id = 3")
    assert rows(spark.table(table)) == [[3, "new", 20]]
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["p"]
