"""WITH RECURSIVE as a fixpoint."""

import random

import pytest

from sluice.engine import Engine
from sluice.errors import FlowError
from sluice.operators import fixpoint as P


@pytest.mark.parametrize("few", [10_000, 3, 0])
def test_reach(spark, monkeypatch, few):
    """The same closure whether rows are held or written, with cycles and nulls."""
    monkeypatch.setattr(P, "FEW", few)
    monkeypatch.setattr(P, "GATHER", 2)
    rng = random.Random(few)
    edges = [(rng.randrange(12), rng.choice([None, *range(12)])) for _ in range(16)]
    spark.createDataFrame(edges, "a int, b int").createOrReplaceTempView("fix_edges")
    want, new = {0, None}, {0, None}
    while new:
        new = {b for a, b in edges if a in new} - want
        want |= new
    got = Engine(spark).sql("with recursive start as (select 0 as n union all select null), r(n) as (select n from start union select b from r join fix_edges on a = n) select n from r").collect()
    assert sorted((r.n for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [10_000, 5])
def test_union_all_and_two_definitions(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    engine = Engine(spark)
    got = engine.sql(
        "with recursive f(n, v, t) as (select 1, cast(1 as bigint), 'union all, f' union all select n + 1, v * 2, t from f where n < 8), half as (select n from f where n % 2 = 0), "
        "g(m) as (select max(n) from half union all select m - 3 from g where m > 2) select count(*) as c, max(v) as v, max(t) as t, (select count(*) from g) as g, (select min(m) from g) as m from f"
    ).collect()
    assert [tuple(r) for r in got] == [(8, 128, "union all, f", 3, 2)]
    twice = engine.sql("with recursive d(n) as (select 1 union all select 1 union all select n + 1 from d where n < 3) select n, count(*) as c from d group by n").collect()
    assert sorted(map(tuple, twice)) == [(1, 2), (2, 2), (3, 2)]
    assert engine.sql("with recursive e(n) as (select 1 where false union all select n + 1 from e) select * from e").collect() == []


def test_a_long_chain(spark):
    """Far more rounds than Spark's own limit of a hundred."""
    rows = Engine(spark).sql("with recursive t(n) as (select 1 union all select n + 1 from t where n < 130) select count(*) as c, sum(n) as s from t").collect()
    assert [tuple(r) for r in rows] == [(130, 130 * 131 // 2)]


def test_errors(spark):
    for text in ("with recursive t as (select n + 1 as n from t) select * from t", "with recursive t(n) as (select 1 union select n, 2 from t) select * from t", "with recursive t select 1"):
        with pytest.raises(FlowError):
            Engine(spark).sql(text).collect()
