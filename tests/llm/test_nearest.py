import numpy as np
import pytest

from sluice.llm import nearest as N
from sluice.llm import queries as Q


def exact(rows, asks, top):
    """Every query against every sound row, in doubles."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = list({(i, tuple(v)) for i, v in rows if i is not None and sound(v)})
    dims = max((len(v) for _, v in rows), default=1)
    x = np.array([list(v) + [0.0] * (dims - len(v)) for _, v in rows]).reshape(-1, dims)
    out = {}
    for i, v in {(i, tuple(v)) for i, v in asks if i is not None and sound(v)}:
        score = np.zeros(len(rows))
        for c, y in enumerate((list(v) + [0.0] * dims)[:dims]):
            score += y * x[:, c]
        for (j, _), s in zip(rows, score, strict=True):
            if j != i:
                own = out.setdefault(i, {})
                own[j] = max(own.get(j, -np.inf), s)
    return {i: sorted(own.items(), key=lambda e: (-e[1], e[0]))[:top] for i, own in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got = out.setdefault(r.query_id, [])
        got.append((r.vec_id, r.score))
        assert r.rank == len(got)
    return out


def recall(got, want):
    assert set(got) <= set(want)
    for i, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda e: (-e[1], e[0])) and len({j for j, _ in pairs}) == len(pairs)
    hit = sum(len({j for j, _ in got.get(i, ())} & {j for j, _ in pairs}) for i, pairs in want.items())
    return hit / sum(map(len, want.values()))


def f32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found(Q.op12_nearest(spark, sf))
    assert recall(got, want) >= 0.95 and all(len(v) == 20 for v in got.values())
    score = {(i, j): s for i, pairs in exact(rows, [r for r in rows if r[0] % 20 == 0], 10**6).items() for j, s in pairs}
    assert all(score[i, j] == s for i, pairs in got.items() for j, s in pairs)


@pytest.mark.parametrize("shape", ["random", "grouped", "lengths"])
def test_recall(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    if shape == "grouped":  # a third of all rows in one tight group, others in small ones
        x = rng.normal(size=(300, 24))[rng.integers(0, 300, 6000)] + 0.1 * rng.normal(size=(6000, 24))
        x[:2000] = x[0] + 0.01 * rng.normal(size=(2000, 24))
    if shape == "lengths":
        x *= rng.lognormal(0, 0.6, size=(6000, 1))
    rows = [(i, f32(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = [r for r in rows if r[0] % 20 == 0]
    got = found(N.search(N.build_index(df), df.where("vec_id % 20 = 0")))
    assert recall(got, exact(rows, asks, 20)) >= 0.93


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((700, 8)) + 0.01 * rng.normal(size=(700, 8)), rng.normal(size=(500, 8))])
    df = spark.createDataFrame([(i, f32(v)) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = found(N.search(N.build_index(df), df.where("vec_id % 20 = 0")))
    monkeypatch.setattr(N, "BLOCK", 37)
    monkeypatch.setattr(N, "PAIRS", 50)
    monkeypatch.setattr(N, "BATCH_BYTES", 1000)
    assert found(N.search(N.build_index(df.repartition(7)), df.where("vec_id % 20 = 0"))) == whole


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [3.0]), (8, [1.0, 2.0, 3.0])]
    rows += [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [2.0, 1.0]), (40, [-2.0, 9.0])] + [(100 + i, [1.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], "vec_id long, embedding array<double>, score double, query_id int, rank int")
    for top in (20, 3):
        got = found(N.search(N.build_index(df, top=top), df.where("vec_id % 20 = 0")))
        assert got == exact(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], top)
    assert [j for j, _ in got[0]] == [40, 20, 100] or len(got[0]) == 3
    none = df.limit(0)
    assert N.search(N.build_index(none), df).count() == 0 and N.search(N.build_index(df), none).count() == 0
    one = spark.createDataFrame([(0, [1, 2])], "vec_id int, embedding array<int>")
    assert N.search(N.build_index(one), one).count() == 0
    with pytest.raises(ValueError):
        N.build_index(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


def test_probes_are_the_nearest_buckets():
    plan = N.Plan(16, 1.0, True, 4000)
    unit = plan.units(np.random.default_rng(1).normal(size=(9, 16)), True)
    assert plan.axes == [16, 3] and plan.buckets == 192
    everything = plan.probed(unit, 2, plan.buckets)
    assert (np.sort(everything, axis=1) == np.arange(plan.buckets)).all()
    assert (everything[:, 0] == plan.keys(unit, 2)).all() and (plan.probed(unit, 2, 25) == everything[:, :25]).all()
    turned = N.turned(unit, 0, 0)
    assert np.allclose(turned @ turned.T, unit @ unit.T)
