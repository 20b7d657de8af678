"""Streams that go on: several runs, runs without input, batches that run again."""

import os
import shutil

from pyspark.sql import functions as F

from sluice.streaming import subscribe as S

SCHEMA = "k string, ts timestamp, v int"


def add(spark, folder, rows):
    spark.createDataFrame(rows, "k string, ts string, v int").selectExpr("k", "cast(ts as timestamp) as ts", "v").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_complete_without_new_input(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    os.makedirs(folder)
    run = lambda: S.run_complete(stream(spark, folder).groupBy("k").agg(F.sum("v").alias("s")), target)
    assert got(run()) == []
    add(spark, folder, [("a", "2024-01-01", 1), ("b", "2024-01-01", 2)])
    assert got(run()) == [("a", 1), ("b", 2)] == got(run())
    add(spark, folder, [("a", "2024-01-02", 5)])
    assert got(run()) == [("a", 6), ("b", 2)] == got(run())
    assert len([n for n in os.listdir(target) if n.startswith("batch=")]) == 1


def test_updates(spark, tmp_path, monkeypatch):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    os.makedirs(folder)
    run = lambda: S.run_updates(stream(spark, folder).groupBy("k").agg(F.sum("v").alias("s"), F.avg("v").alias("m")), ["k"], target)
    assert got(run()) == []
    add(spark, folder, [("a", "2024-01-01", 1), ("b", "2024-01-01", 2), (None, "2024-01-01", 9)])
    first = run()
    assert sorted(first.collect(), key=str) == sorted(run().collect(), key=str) and first.count() == 3
    add(spark, folder, [("a", "2024-01-02", 5)])
    assert {r.k: (r.s, r.m) for r in run().collect()} == {"a": (6, 3.0), "b": (2, 2.0), None: (9, 9.0)}
    newest = max((n for n in os.listdir(target) if n.startswith("batch=")), key=lambda n: int(n[6:]))
    assert spark.read.parquet(f"{target}/{newest}").count() == 1  # only what changed
    # the last batch runs again: its commit is gone
    last = max(os.listdir(f"{target}-checkpoint/commits"), key=lambda n: (n.isdigit(), n))
    os.remove(f"{target}-checkpoint/commits/{last}")
    if os.path.exists(f"{target}-checkpoint/commits/.{last}.crc"):
        os.remove(f"{target}-checkpoint/commits/.{last}.crc")
    assert {r.k: r.s for r in run().collect()} == {"a": 6, "b": 2, None: 9}
    monkeypatch.setattr(S, "COMPACT", 1)
    assert {r.k: r.s for r in run().collect()} == {"a": 6, "b": 2, None: 9}
    assert [n[:5] for n in os.listdir(target)] == ["base="]
    add(spark, folder, [("b", "2024-01-03", 1), ("c", "2024-01-03", 1)])
    assert {r.k: r.s for r in run().collect()} == {"a": 6, "b": 3, "c": 1, None: 9}


def test_late_rows(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    os.makedirs(folder)
    run = lambda: [sorted((r.v, r.batch) for r in df.collect()) for df in S.split_late(stream(spark, folder), "ts", "1d", target)]
    assert run() == [[], []]
    add(spark, folder, [("a", "2024-01-10", 1), ("a", "2024-01-01", 2), ("a", None, 3)])
    assert run() == [[(1, 0), (2, 0), (3, 0)], []] == run()
    add(spark, folder, [("a", "2024-01-08", 4), ("a", "2024-01-09", 5), ("a", None, 6)])
    assert run() == [[(1, 0), (2, 0), (3, 0), (5, 1), (6, 1)], [(4, 1)]]
    shutil.rmtree(f"{target}/late/batch=1")  # broken off before its commit: it runs again to the same end
    os.remove(f"{target}-checkpoint/commits/1")
    if os.path.exists(f"{target}-checkpoint/commits/.1.crc"):
        os.remove(f"{target}-checkpoint/commits/.1.crc")
    assert run() == [[(1, 0), (2, 0), (3, 0), (5, 1), (6, 1)], [(4, 1)]]


def test_interval_join(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    os.makedirs(left)
    os.makedirs(right)
    add(spark, left, [("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-01 10:00:00", 2)])
    add(spark, right, [("a", "2024-01-01 09:00:00", 10), ("a", "2024-01-01 08:59:59", 11), ("b", "2024-01-01 10:06:00", 12)])

    def run():
        r = stream(spark, right).select("k", F.col("ts").alias("rt"), F.col("v").alias("w"))
        pairs = S.interval_join(stream(spark, left), r, ["k"], "ts", "rt", "1h", "5m", "1d")
        return got(S.run_available(pairs, f"{tmp_path}/c", f"{tmp_path}/o").select("k", "v", "w"))

    assert run() == [("a", 1, 10)] == run()
    add(spark, left, [("b", "2024-01-01 10:01:00", 3)])
    assert run() == [("a", 1, 10), ("b", 3, 12)]
