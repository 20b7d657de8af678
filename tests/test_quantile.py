"""Exact quantiles, histograms and grouping sets against Spark's own aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.api import flow
from sluice.engine import Engine
from sluice.operators import global_window as W
from sluice.operators import quantile


@pytest.fixture
def table(spark, monkeypatch):
    monkeypatch.setattr(W, "SMALL", -1)
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice("xyz"), rng.choice([None, float("nan"), float("inf"), -0.0, *[rng.gauss(0, 9) for _ in range(30)]]), rng.randrange(40)) for _ in range(500)]
    rows += [(9, "x", None, 1), (10, "y", 2.5, None)]
    df = spark.createDataFrame(rows, "g int, h string, x double, n int")
    df.createOrReplaceTempView("q_table")
    return df


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert str(x) == str(y) or x == pytest.approx(y)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quantiles(spark, table):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for keys in ([], ["g"], ["g", "h"]):
        for x, most in (("x", 5), ("n", 1), ("n", 64)):
            wanted = {f"p{i}": p for i, p in enumerate(shares)}
            got = quantile.exact(table, keys, F.col(x), wanted, most)
            plain = table.where(F.col(x).isNotNull()).groupBy(*keys).agg(*[F.percentile(x, p).alias(n) for n, p in wanted.items()])
            assert len(rows(got)) == len(rows(plain))
            for a, b in zip(rows(got), rows(plain), strict=True):
                close(a, b)


def test_in_queries(spark, table):
    engine = Engine(spark)
    got = engine.query("from q_table group by g agg x.median as m, _.count as c, histogram(n) as h, n.sum + n.median as both where c > 1").collect()
    plain = {r.g: r for r in table.groupBy("g").agg(F.median("x").alias("m"), F.count("*").alias("c"), F.collect_list("n").alias("l"), (F.sum("n") + F.median("n")).alias("both")).where("c > 1").collect()}
    assert len(got) == len(plain)
    for r in got:
        close((r.m, r.c, r.both), (plain[r.g].m, plain[r.g].c, plain[r.g].both))
        assert r.h == {v: plain[r.g].l.count(v) for v in plain[r.g].l} and list(r.h) == sorted(r.h)
    only = engine.query("from q_table select n.median as m, quantile_cont(n, 0.9) as q").collect()
    assert [tuple(r) for r in only] == [tuple(table.agg(F.median("n"), F.percentile("n", 0.9)).first())]
    lone = engine.query("from q_table where g >= 9 group by g agg x.median as m, histogram(x) as h").collect()
    assert sorted((r.g, r.m, r.h) for r in lone) == [(9, None, {}), (10, 2.5, {2.5: 1})]
    none = engine.query("from q_table where g > 99 select x.median as m, histogram(x) as h, _.count as c").collect()
    assert [(r.m, r.h or {}, r.c) for r in none] == [(None, {}, 0)]


def test_sorted_rows_are_few(spark):
    """Of a hot group only the ranges that hold its middle are sorted."""
    df = spark.range(40_000).select((F.col("id") % 40 == 0).cast("int").alias("g"), F.xxhash64("id").alias("x"))
    got = quantile.exact(df, ["g"], F.col("x"), {"m": 0.5}, 32)
    assert {r._g0: r.m for r in got.collect()} == {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    plan = quantile.exact(df, [], F.col("x"), {"m": 0.5})._jdf.queryExecution().executedPlan().toString().split("\n")
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert single and all("partial_" in plan[i + 1] for i in single)  # one row of each task


@pytest.mark.parametrize("kind", ["cube", "rollup"])
def test_grouping_sets_from_the_finest(spark, table, kind):
    made = getattr(flow(Engine(spark), "q_table"), kind)("g", "h").agg("_.count as c", "n.sum as s", "n.avg as a", "x.max as t", "n.min as l", "count_if(n > 5) as k").df()
    plain = getattr(table, kind)("g", "h").agg(F.count("*"), F.sum("n"), F.avg("n"), F.max("x"), F.min("n"), F.count_if(F.col("n") > 5))
    for a, b in zip(rows(made), rows(plain), strict=True):
        close(a, b)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # what is copied for each set is aggregated before
    sets = flow(Engine(spark), "q_table").grouping_sets(["g", "h"], [[0], [1], []]).agg("n.count_distinct as d").df()
    assert sets.count() == table.groupingSets([["g"], ["h"], []], "g", "h").agg(F.count("*")).count()
