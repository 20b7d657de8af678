"""Joins and subqueries on inequalities: results against loops over pairs, plans without them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice import queries as Q
from sluice.engine import Engine
from sluice.operators import band
from sluice.operators import global_window as W

NAMES = ("join_band", "join_band_dates", "join_band_left", "join_overlap", "join_two_inequalities", "scalar_running_avg", "scalar_running_global", "semi_exists_less", "anti_exists_less")


@pytest.mark.parametrize("name", NAMES)
def test_no_loop_over_pairs(spark, name):
    plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def le(a, b):
    """a <= b where NaN is the greatest, and unknown with nulls."""
    return a is not None and b is not None and (math.isnan(b) or (not math.isnan(a) and a <= b))


def sides(seed):
    rng = random.Random(seed)
    nan, inf = float("nan"), float("inf")
    value = lambda: rng.choice([None, nan, inf, -inf, 0.0, 1e12, *[rng.uniform(-50, 50) for _ in range(20)]])
    a = [(i, value(), value()) for i in range(60)] + [(1000, -1e13, 1e13), (1001, 3.0, 3.0), (1001, 3.0, 3.0)]
    b = [(i, x, None if x is None else x + rng.uniform(-1, 9)) for i, x in ((i, value()) for i in range(70))]
    return a, b


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_overlaps(spark, kind):
    a, b = sides(kind)
    spark.createDataFrame(a, "i int, lo double, hi double").createOrReplaceTempView("a")
    spark.createDataFrame(b, "j int, p double, q double").createOrReplaceTempView("b")
    pairs = [(x, y) for x in a for y in b if le(x[1], y[2]) and le(y[1], x[2]) and (x[0] + y[0]) % 7 != 1]
    want = [(x[0], y[0]) for x, y in pairs]
    if kind in ("left", "full"):
        met = {str(x) for x, _ in pairs}
        want += [(x[0], None) for x in a if str(x) not in met]
    if kind in ("right", "full"):
        met = {str(y) for _, y in pairs}
        want += [(None, y[0]) for y in b if str(y) not in met]
    prefix = "" if kind == "inner" else kind + " "
    got = Engine(spark).query(f"from a {prefix}join b on a.lo <= b.q and b.p <= a.hi and (i + j) % 7 != 1 select i, j")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_outer_joins_look_for_one_partner_and_buckets_are_tasks(spark):
    """Rows that are alone are not found by way of all pairs, and few bytes of rows with many partners are many tasks."""
    a = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") % 50).cast("double").alias("x"))
    b = spark.range(3000).select(F.col("id").alias("j"), (F.col("id") % 60 - 5).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    got = band.overlap_join(a, b, (x - 1, x), (y, y), (x - 1 <= y) & (y <= x), "full")
    assert got.where("i is null").count() == sum(v % 60 - 5 not in range(-1, 50) for v in range(3000))
    assert got.where("i is not null and j is not null").count() == 4000 * 50 * 2
    assert got.rdd.getNumPartitions() >= 16
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 4 and plan.count("Join Inner") == 2


def test_partners_are_looked_for_in_the_tasks_of_the_shuffle(spark):
    """A broadcast would look for them in as few tasks as a side has files, and for the one bucket where a pair counts."""
    a = spark.range(0, 4000, 1, 1).select(F.col("id").alias("i"), (F.col("id") % 50).cast("double").alias("x"))
    b = spark.range(0, 3000, 1, 1).select(F.col("id").alias("j"), (F.col("id") % 60 - 5).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    plan = band.overlap_join(a, b, (x - 1, x), (y, y), (x - 1 <= y) & (y <= x), "full")._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(semi) == 4
    assert all("SortMergeJoin" in line and "greatest" not in line for line in semi)


def test_lengths_changed_by_rounding_share_a_scale(spark):
    """x to x + 8 is 8 long or a trifle more: still one scale, and the same pairs."""
    rng = random.Random(8)
    a, b = ([(i, round(rng.uniform(-1000, 10000), 2)) for i in range(n)] for n in (500, 400))
    assert len({x + 8 - x > 8 for _, x in a}) == 2
    sides = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double")
    x, y = F.col("x"), F.col("y")
    got = band.overlap_join(*sides, (x, x + 8), (y, y + 8), (x < y + 8) & (y < x + 8))
    assert sorted((r.i, r.j) for r in got.collect()) == [(i, j) for i, v in a for j, w in b if v < w + 8 and w < v + 8]
    assert set(re.findall(r"filter\((\[[-\d,]+\])", got._jdf.queryExecution().optimizedPlan().toString())) == {"[3]"}


@pytest.mark.parametrize("length", [8.0, 8.0 + 2.0**-15, 8.0 + 2.0**-13, 3.0])
def test_intervals_at_the_edges_of_buckets(spark, length):
    """Lengths at and beside a power of two, begun at and beside the edges of its buckets, also below zero."""
    starts = [k * 8.0 + d for k in range(-3, 4) for d in (0.0, -(2.0**-15), 2.0**-15, 7.9999999)]
    a = [(i, v, v + length) for i, v in enumerate(starts)]
    b = [(j, v, v + n) for j, (v, n) in enumerate((v, n) for v in starts for n in (0.0, 8.0, 16.0))]
    sides = spark.createDataFrame(a, "i int, lo double, hi double"), spark.createDataFrame(b, "j int, p double, q double")
    condition = (F.col("lo") <= F.col("q")) & (F.col("p") <= F.col("hi")) & (F.col("i") % 3 != 0)
    got = band.overlap_join(*sides, (F.col("lo"), F.col("hi")), (F.col("p"), F.col("q")), condition, "full")
    pairs = [(i, j) for i, lo, hi in a for j, p, q in b if lo <= q and p <= hi and i % 3]
    want = pairs + [(i, None) for i, *_ in a if i not in {x for x, _ in pairs}] + [(None, j) for j, *_ in b if j not in {y for _, y in pairs}]
    assert sorted(map(str, want)) == sorted(str((r.i, r.j)) for r in got.collect())


def test_one_interval_over_everything(spark):
    """The longest interval costs as many rows as any other, and points are not copied for each of its buckets."""
    points = spark.range(3000).select(F.col("id").alias("x"))
    wide = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") == 0, -1e15).otherwise(F.col("id") * 10.0).alias("lo"), F.when(F.col("id") == 0, 1e15).otherwise(F.col("id") * 10.0 + 2).alias("hi"))
    x = F.col("x").cast("double")
    got = band.overlap_join(points, wide, (x, x), (F.col("lo"), F.col("hi")), (F.col("lo") <= x) & (x <= F.col("hi")))
    assert got.count() == 3000 + 3 * 299


OPS = {"<": lambda a, b: le(a, b) and not le(b, a), "<=": le, ">": lambda a, b: le(b, a) and not le(a, b), ">=": lambda a, b: le(b, a)}


@pytest.mark.parametrize("op", list(OPS))
def test_subqueries(spark, op):
    rng = random.Random(op)
    value = lambda: rng.choice([None, float("nan"), 1.0, 2.0, rng.uniform(0, 4)])
    inner = [(rng.choice([None, 1, 2, 2, 2]), value(), rng.choice([None, *range(9)])) for _ in range(60)]
    outer = [(i, rng.choice([None, 1, 2, 2, 3]), value()) for i in range(50)]
    spark.createDataFrame(inner, "k int, v double, w int").createOrReplaceTempView("inn")
    spark.createDataFrame(outer, "i int, g int, t double").createOrReplaceTempView("out")
    hits = {i: [w for k, v, w in inner if k is not None and k == g and OPS[op](v, t) and w != 4 and w is not None] for i, g, t in outer}
    engine = Engine(spark)
    where = f"from inn where k = g and v {op} t where w != 4"
    there = engine.query(f"from out where exists {{ {where} }} select i").collect()
    assert sorted(r.i for r in there) == [i for i in hits if hits[i]]
    missing = engine.query(f"from out where not exists {{ {where} select w, k }} select i").collect()
    assert sorted(r.i for r in missing) == [i for i in hits if not hits[i]]
    got = engine.query(f"from out add n = {{ {where} select _.count }}, s = 2 * {{ {where} select w.sum + 1 }}, m = {{ {where} agg w.max }}, a = {{ {where} select w.avg }} select i, n, s, m, a")
    mean = lambda h: sum(h) / len(h) if h else None
    assert {r.i: tuple(r)[1:] for r in got.collect()} == {i: (len(h), 2 * (sum(h) + 1) if h else None, max(h, default=None), mean(h)) for i, h in hits.items()}
    free = engine.query(f"from out where exists {{ from inn where v {op} t }} select i").collect()
    assert sorted(r.i for r in free) == [i for i, _, t in outer if any(OPS[op](v, t) for _, v, _ in inner)]


def test_a_hot_key_is_many_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("t"))
    keys = [W.Key(F.col("k"), False, True), W.Key(F.col("t"), False, True)]
    counts = [r["count"] for r in rows.groupBy(W.range_of(keys, W.splitters(rows, keys, 16))).count().collect()]
    assert len(counts) == 16 and max(counts) < 2.5 * 20_000 / 16
    ran = W.running_by(rows, ["k"], keys[1:], [F.count(F.lit(1))], [W.added], ["n"], 16).where("k = 7").agg(F.max("n"), F.count_distinct("n")).first()
    assert tuple(ran) == (rows.where("k = 7").count(),) * 2
