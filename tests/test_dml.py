"""UPDATE, DELETE, MERGE: clause order, quoted text, and which files are written."""

import os
import uuid

import pytest

from sluice.engine import Engine
from sluice.errors import FlowError
from sluice.sources import sinks, touched


@pytest.fixture
def engine(spark):
    return Engine(spark)


def made(spark, rows, schema, files=1):
    name = f"dml_{uuid.uuid4().hex[:8]}"
    spark.createDataFrame(rows, schema).repartition(files).write.saveAsTable(name)
    return name


def rows(spark, table):
    return sorted(tuple(r) for r in spark.table(table).collect())


def files(spark, table):
    folder = next(r.data_type for r in spark.sql(f"describe formatted {table}").collect() if r.col_name == "Location").removeprefix("file:")
    return folder, {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in os.listdir(folder) if n.endswith(".parquet")}


def test_first_clause_wins(engine, spark):
    t = made(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, s string")
    engine.sql(f"merge into {t} t using (select * from values (1, 'x'), (2, 'y') as v(k, s)) s on t.k = s.k when matched and t.k = 1 then update set s = s.s when matched then delete")
    assert rows(spark, t) == [(1, "x"), (3, "c")]
    engine.sql(f"merge into {t} t using (select * from values (5, 'x'), (6, 'y'), (7, 'z') as v(k, s)) s on t.k = s.k when not matched and s.k = 5 then insert (k, s) values (s.k, 'five') when not matched and s.k < 7 then insert *")
    assert rows(spark, t) == [(1, "x"), (3, "c"), (5, "five"), (6, "y")]
    engine.sql(f"merge into {t} using (select 3 as k, 'n' as s) as n on {t}.k = n.k when matched then update set *")
    assert (3, "n") in rows(spark, t)


def test_two_source_rows(engine, spark):
    t = made(spark, [(1, "a")], "k int, s string")
    twice = "(select * from values (1, 'x'), (1, 'y') as v(k, s))"
    with pytest.raises(FlowError, match="two source rows"):
        engine.sql(f"merge into {t} t using {twice} s on t.k = s.k when matched then update set s = s.s")
    assert rows(spark, t) == [(1, "a")]
    engine.sql(f"merge into {t} t using {twice} s on t.k = s.k when matched and s.s = 'y' then update set s = s.s when not matched then insert (k) values (0)")
    assert rows(spark, t) == [(1, "y")]


def test_quoted_words(engine, spark):
    t = made(spark, [(1, "a"), (2, "b")], "k int, s string")
    engine.sql(f"update {t} set s = 'up where down' where k = 1")
    engine.sql(f"update {t} set s = concat('when matched then delete, ', s, ', \"values\" (1, 2)'), k = k + 10 where s = 'b' or s = 'set x = 1 where'")
    assert rows(spark, t) == [(1, "up where down"), (12, "when matched then delete, b, \"values\" (1, 2)")]
    engine.sql(f"merge into {t} t using (select 'a) on b when matched' as s, 1 as k) s on t.k = s.k when matched and t.s = 'up where down' then update set s = concat(s.s, ' then ', 'insert, values (')")
    engine.sql(f"delete from {t} where s = 'x where y' or k > (select 10)")
    assert rows(spark, t) == [(1, "a) on b when matched then insert, values (")]
    for wrong in ("set z = 1", "set k"):
        with pytest.raises((FlowError, ValueError)):
            engine.sql(f"update {t} {wrong}")
    with pytest.raises(FlowError):
        engine.sql(f"merge into {t} t using (select 1 as k) s on t.k = s.k when matched then insert (k) values (1)")


def test_only_touched_files_are_written(engine, spark):
    t = made(spark, [(i, i % 4) for i in range(400)], "k int, v int", 20)
    _, before = files(spark, t)
    assert len(before) == 20
    engine.sql(f"update {t} set v = -1 where k = 7")
    _, after = files(spark, t)
    assert sum(after.get(n) == at for n, at in before.items()) == 19 and len(after) == 20
    engine.sql(f"merge into {t} t using (select 8 as k) s on t.k = s.k when matched then delete when not matched then insert (k) values (s.k)")
    engine.run(f"from {t} as x where x.k = 9 where v >= 0 delete")
    _, last = files(spark, t)
    assert sum(last.get(n) == at for n, at in before.items()) >= 17
    assert rows(spark, t) == sorted((i, -1 if i == 7 else i % 4) for i in range(400) if i not in (8, 9))
    engine.sql(f"delete from {t} where k = 1000")
    engine.sql(f"merge into {t} t using (select 1000 as k) s on t.k = s.k when matched then delete")
    assert files(spark, t)[1] == last
    engine.sql(f"alter table {t} set properties primary_key = 'k'")
    engine.sql(f"upsert into {t} (k, v) select * from values (7, 70), (1000, 1) as x(k, v)")
    assert sum(n not in last for n in files(spark, t)[1]) <= 3 and {(7, 70), (1000, 1)} <= set(rows(spark, t))
    engine.sql(f"delete from {t}")
    assert rows(spark, t) == []


def test_a_change_that_was_broken_off(engine, spark, monkeypatch):
    """The journal holds the change: whatever step the driver died at, the next change finishes it."""
    for steps in range(4):
        t = made(spark, [(i, 0) for i in range(40)], "k int, v int", 4)
        real, left = touched._finish, [steps]

        def dies(spark, journal, left=left):
            fs = journal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            lines = bytes(fs.open(journal).readAllBytes()).decode().split("\n")
            for kind, *names in (line.split(" ") for line in lines):
                if left[0] == 0:
                    break
                left[0] -= 1
                sub = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal.getParent(), n) for n in names]
                fs.rename(*sub) if kind == "add" else fs.delete(sub[0], False)
            raise KeyboardInterrupt

        monkeypatch.setattr(touched, "_finish", dies)
        with pytest.raises(KeyboardInterrupt):
            engine.sql(f"update {t} set v = 1 where k % 2 = 0")
        monkeypatch.setattr(touched, "_finish", real)
        engine.sql(f"update {t} set v = 2 where k = 3")
        assert rows(spark, t) == [(i, 2 if i == 3 else 1 - i % 2) for i in range(40)]
        assert not [n for n in os.listdir(files(spark, t)[0]) if n.startswith(("_change", "_staged"))]


def test_partitions_and_other_formats(engine, spark):
    t = f"dml_{uuid.uuid4().hex[:8]}"
    sinks.save_table(spark.createDataFrame([(i, i % 3) for i in range(12)], "k int, p int"), t, {"partition_by": "p"})
    engine.sql(f"update {t} set p = 9 where k = 4")
    engine.sql(f"merge into {t} t using (select 5 as k union all select 50) s on t.k = s.k when matched then delete when not matched then insert (k, p) values (s.k, 1)")
    assert rows(spark, t) == sorted([(i, 9 if i == 4 else i % 3) for i in range(12) if i != 5] + [(50, 1)])
    assert [c.name for c in spark.catalog.listColumns(t) if c.isPartition] == ["p"]
    c = f"dml_{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string").write.format("csv").saveAsTable(c)
    engine.sql(f"update {c} set s = 'z' where k = 2")
    assert rows(spark, c) == [(1, "a"), (2, "z")]
