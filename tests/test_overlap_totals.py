"""Groups over joins of overlapping intervals: results against loops over pairs, and no pairs in the plan."""

import random

import pytest

from sluice.engine import Engine

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


@pytest.mark.parametrize(("up", "down", "tags", "wrong"), [("<", "<=", 60, 0), ("<=", "<", 2, 0), ("<", "<", None, 0), ("<=", "<=", 3, 2)])
def test_as_pairs(spark, up, down, tags, wrong):
    rng = random.Random(f"{up}{down}{tags}")
    value = lambda: rng.choice([None, float("-inf"), float("inf"), -0.0, 0.0, *[rng.randrange(-20, 20) / 4 for _ in range(40)]])

    def rows(n):
        out = []
        for i in range(n):
            lo, hi = value(), value()
            if lo is not None and hi is not None and i >= wrong:
                lo, hi = min(lo, hi), max(lo, hi)
            out.append((rng.choice([None, *range(9)]), lo, hi, rng.choice([None, *range(tags or 9)]), rng.choice([None, rng.randrange(50)])))
        return out

    a, b = rows(50), rows(40)
    spark.createDataFrame(a, "g int, lo double, hi double, x int, w int").createOrReplaceTempView("ot_a")
    spark.createDataFrame(b, "h int, p double, q double, y int, v int").createOrReplaceTempView("ot_b")
    want = {}
    for g, lo, hi, x, _ in a:
        for _, p, q, y, v in b:
            if None not in (lo, hi, p, q) and OPS[up](lo, q) and OPS[down](p, hi) and (tags is None or (x is not None and y is not None and x != y)):
                want.setdefault(g, []).append((v, y))
    given = lambda values: [x for x in values if x is not None]
    want = {g: (len(r), len(given(v for v, _ in r)), min(given(v for v, _ in r), default=None), max(given(v for v, _ in r), default=None), min(given(y for _, y in r), default=None)) for g, r in want.items()}
    got = Engine(spark).query(f"from ot_a join ot_b on lo {up} q and p {down} hi{'' if tags is None else ' and x != y'} group by g agg _.count as n, count(v) as k, v.min as least, max(v) as most, y.min as first")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and len(want) > 8
    assert "_node" in got._jdf.queryExecution().executedPlan().toString()


def test_other_groups_stay_pairs(spark):
    spark.createDataFrame([(1, 0.0, 2.0), (2, 1.0, 3.0)], "g int, lo double, hi double").createOrReplaceTempView("ot_a")
    spark.createDataFrame([(1, 0.5, 1.5, 0.1), (3, 2.5, 9.0, 0.2)], "h int, p double, q double, v double").createOrReplaceTempView("ot_b")
    engine = Engine(spark)
    for text, want in (
        ("on lo < q and p < hi and g < h + 3 group by g agg _.count as n", {(1, 1), (2, 2)}),
        ("on lo < q and p < hi group by h agg _.count as n", {(1, 2), (3, 1)}),
        ("on lo < q and p < hi group by g agg v.sum.round(3) as s", {(1, 0.1), (2, 0.3)}),
        ("on lo < q and p < hi group by g agg max(v + lo) as s", {(1, 0.1), (2, 1.2)}),
        ("on lo < q and p < hi where v > 0.15 group by g agg _.count as n", {(2, 1)}),
        ("on lo < q and p < hi group by g agg _.count as n, v.min as m where n > 1", {(2, 2, 0.1)}),
    ):
        assert {tuple(r) for r in engine.query(f"from ot_a join ot_b {text}").collect()} == want, text
