"""Windows over one order: by ranges, against Spark's own single-task windows."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice import queries as Q
from sluice.engine import Engine
from sluice.operators import global_window as W

FLOW = """from t select id,
rank() over (order by {key}) as r, dense_rank() over (order by {key}) as d, row_number() over (order by {key}, id) as i, percent_rank() over (order by {key}) as p,
cume_dist() over (order by {key}) as c, ntile({tiles}) over (order by {key}, id) as q, lag(v, {n}) over (order by {key}, id) as b, lead(v, {n}, id) over (order by {key}, id) as a,
sum(v) over (order by {key}) as s, count(v) over (order by {key}) as k, avg(v) over (order by {key}, id rows [,0]) as m, min(m) over (order by {key}) as lo, max(f) over (order by {key}) as hi,
sum(m) over (order by {key}, id rows [-{n}, 2]) as near, count(*) over (order by {key}, id rows [1, 3]) as later, sum(m) over (order by {key}) as sm, v.sum() over () as total, max(v) over () as top"""


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            i, rng.choice([None, "a", "b", "ü", "'q'", ""]), rng.choice([None, rng.randrange(9)]), rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, rng.random()]),
            Decimal(rng.randrange(999)) / 100, rng.choice([None, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(5))]), rng.choice([None, True, False]),
        ))
    return spark.createDataFrame(rows, "id long, s string, v int, f double, m decimal(9,2), d date, b boolean")


def result(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("key", ["s desc, b", "f desc nulls first, d", "id % 2"])
def test_as_one_task(spark, monkeypatch, key):
    for n, tiles, reach in ((60, 7, 3), (0, 2, 1)):
        table(spark, n).createOrReplaceTempView("t")
        text = FLOW.format(key=key, tiles=tiles, n=reach)
        monkeypatch.setattr(W, "SMALL", 1 << 62)
        plain = Engine(spark).query(text)
        monkeypatch.setattr(W, "SMALL", -1)
        spread = Engine(spark).query(text)
        assert spread.dtypes == plain.dtypes
        assert result(spread) == result(plain)


def test_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(W, "SMALL", -1)
    for name in ("win_global_rank", "win_global_lag", "win_percent_cume", "win_over_aggregate"):
        plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "rangepartitioning" not in plan, name


def test_a_hot_key_is_many_ranges(spark, monkeypatch):
    """Rows of one very frequent key, nulls too, are many ranges, with the same results; code stays short for many splitters."""
    monkeypatch.setattr(W, "SMALL", 1 << 62)
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 100)).alias("v"), (F.col("id") * 7 % 501).alias("m"))
    df.createOrReplaceTempView("hot")
    text = """from hot select id, rank() over (order by v) as r, dense_rank() over (order by v) as d, row_number() over (order by v, id) as i, cume_dist() over (order by v) as c,
sum(m) over (order by v) as s, min(m) over (order by v) as lo, avg(m) over (order by v desc) as a, lag(m, 2) over (order by v, id) as b"""
    plain = result(Engine(spark).query(text))
    monkeypatch.setattr(W, "SMALL", -1)
    monkeypatch.setattr(W, "ranges_of", lambda df: 24)
    assert result(Engine(spark).query(text)) == plain
    keys = [W.Key(F.col("v"), False, False)]
    cuts, first = W.splitters_of_ties(df, keys, 24)
    tie = W.Key(F.shiftright(F.xxhash64("id"), 1), False, False)
    counts = df.groupBy(W.range_of([*keys, tie], cuts).alias("g")).count().collect()
    assert max(r["count"] for r in counts) < 2.5 * 6000 / 24 and len(first) == len(cuts) + 1
    many = [[F.lit(i)] for i in range(1000)]
    assert df.agg(F.max(W.range_of(keys, many)), F.min(W.range_of(keys, many))).first()[:] == (1000, 2)


def test_rows_of_a_range(spark):
    """No range holds much more than its share, and ties are never cut."""
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 50).alias("j"))
    for column, most in (("k", 2.5), ("j", 1.5)):
        key = [W.Key(F.col(column), False, False)]
        got = df.groupBy(W.range_of(key, W.splitters(df, key, 16)).alias("r")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("r").collect()
        assert len(got) == 16 and max(r.n for r in got) < most * 20_000 / 16 + 400
        assert all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False))


def test_filters_groups_and_aliases(spark, monkeypatch):
    monkeypatch.setattr(W, "SMALL", -1)
    table(spark, 90).createOrReplaceTempView("t")
    engine = Engine(spark)
    best = engine.query("from t where v is not null where rank() over (order by v desc, id) <= 5 select id, v").collect()
    want = sorted((-r.v, r.id) for r in spark.table("t").collect() if r.v is not None)[:5]
    assert sorted((-r.v, r.id) for r in best) == want
    twice = engine.query("from t select id, twice = v * 2, r = rank() over (order by twice, id)").collect()
    assert sorted(twice, key=lambda r: r.r) == sorted(twice, key=lambda r: (r.twice is None, r.twice, r.id)) and twice[0].__fields__ == ["id", "twice", "r"]
    grouped = engine.query("from t group by s agg _.count as n add share = n / n.sum() over (), place = row_number() over (order by n desc, s)").collect()
    assert sum(r.share for r in grouped) == pytest.approx(1) and sorted(r.place for r in grouped) == list(range(1, len(grouped) + 1))
