import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import substring_dedup as D


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["new"], [w[i], "more"]])
    return w


def test_planted_passages(spark):
    rng = random.Random(8)
    exact, fuzzy = words(rng, 60), words(rng, 120)
    rows = [(i, " ".join(words(rng, 200))) for i in range(40)]
    rows += [(100 + i, " ".join(words(rng, 80) + exact + words(rng, 30))) for i in range(30)]
    rows += [(200 + i, " ".join(words(rng, 50) + edited(rng, fuzzy, 5) + words(rng, 60))) for i in range(10)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    rows += [(400 + i, " ".join(words(rng, 50) + exact[:30] + words(rng, 60))) for i in range(5)]
    rows += [(500, None), (501, ""), (None, " ".join(exact)), (502, " ".join(exact[:20]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind").repartition(4)
    got = D.repeated_passages(docs).collect()
    flagged = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert flagged == {None, 0, *range(100, 130), *range(200, 210), *range(300, 320)}
    text = {d: t.split() for d, t in rows if t}
    wide = []
    for r in got:
        a, b = text[r.doc_id][r.start_word : r.end_word], text[r.other_doc_id][r.other_start : r.other_end]
        if r.kind == "copy" or r.doc_id is None or r.doc_id < 200:
            assert a == b and len(a) >= 60 and r.similarity == 1
        else:
            wide.append(len(a))
            assert len(a) >= D.LEAST and r.matches <= D._common(np.array([hash(x) for x in a]), np.array([hash(x) for x in b]))
    assert sum(n > 90 for n in wide) >= 7  # of nine; a cluster of edits may end a passage early
    assert sum(r.kind == "copy" for r in got) == 20
    assert D.repeated_passages(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80), st.integers(5, 20)), min_size=1, max_size=9))
def test_chain_against_brute_force(segments):
    su, sv, size = map(np.array, zip(*segments, strict=True))
    end = size - np.minimum(size, 5)
    best = [0.0] * len(su)
    order = np.lexsort((sv, su)).tolist()
    for x, i in enumerate(order):
        best[i] = float(size[i])
        for j in order[:x]:
            if su[j] + end[j] <= su[i] and sv[j] + end[j] <= sv[i]:
                gap = su[i] - su[j] - end[j] + sv[i] - sv[j] - end[j]
                best[i] = max(best[i], size[i] + best[j] - 0.5 * gap)
    chains = D.chain(su, sv, size, 0.5, 5)
    assert sorted(i for c in chains for i in c) == list(range(len(su)))
    first = chains[0]
    score = float(size[first[0]])
    for j, i in zip(first, first[1:], strict=False):
        score += size[i] - 0.5 * (su[i] - su[j] - end[j] + sv[i] - sv[j] - end[j])
    assert abs(score - max(best)) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert D._common(np.array(a, int), np.array(b, int)) == t[-1][-1]


def aligned(u, v):
    a, b = (np.array([hash(x) for x in w], np.int64).view(np.uint64) for w in (u, v))
    places = [dict(zip(h.tolist(), at.tolist(), strict=True)) for h, at in (D.seeds(w, np.array([0, len(w)])) for w in (a, b))]
    both = [h for h in places[0] if h in places[1]]
    return D.passages(a, b, *(np.array([p[h] for h in both], np.int64) for p in places))


def test_long_passages_around_an_insertion():
    rng = random.Random(5)
    head, tail = words(rng, 400), words(rng, 400)
    between = words(rng, 600)
    assert aligned(head + tail, head + between + tail) == [(0, 400, 0, 400, 400), (400, 800, 1000, 1400, 400)]
    assert aligned(head + between + tail, head + tail) == [(0, 400, 0, 400, 400), (1000, 1400, 400, 800, 400)]
    parts = [words(rng, 100) for _ in range(4)]
    spread = [w for p in parts for w in p + words(rng, 120)]
    assert [p[:2] for p in aligned([w for p in parts for w in p], spread)] == [(0, 100), (100, 200), (200, 300), (300, 400)]


def test_equal_words_between_edits():
    rng = random.Random(9)
    core = words(rng, 50)
    u, v = list(core), list(core)
    for _ in range(12):
        same = words(rng, 4)
        u, v = u + words(rng, 4) + same, v + words(rng, 1) + same
    assert any(p[0] == 0 and p[1] >= 50 for p in aligned(u, v))


def table(spark, rows, parts=1):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1).repartition(parts)


def test_first_places_with_parts_only(spark):
    rng = random.Random(4)
    core = words(rng, 100)
    rows = [(i, words(rng, 50) + core[a:b] + words(rng, 50)) for i, (a, b) in enumerate([(0, 44), (28, 72), (56, 100)])]
    rows += [(i, words(rng, 10 * i) + core + words(rng, 30)) for i in (8, 9)]
    for parts in (1, 5):
        got = [(r.doc_id, r.other_doc_id, r.end_word - r.start_word) for r in D.repeated_passages(table(spark, rows, parts)).collect()]
        assert [(max(a, b), min(a, b), n) for a, b, n in got] == [(9, 8, 100)]


def test_repeats_against_brute_force(spark):
    """Texts of pieces that begin and end anywhere: whoever shares LEAST words in a row is linked."""
    for seed in range(3):
        rng = random.Random(seed)
        pool = [words(rng, rng.choice([60, 100, 200])) for _ in range(6)]
        rows = []
        for i in range(40):
            w = words(rng, rng.randrange(40))
            for _ in range(rng.randrange(4)):
                p = rng.choice(pool)
                a = rng.randrange(len(p) - 20)
                w += p[a : a + rng.randrange(20, 110)] + words(rng, rng.randrange(30))
            rows.append((i, w))
        got = D.repeated_passages(table(spark, rows, 1 + 3 * seed)).collect()
        text = dict(rows)
        root = {i: i for i, _ in rows}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in got:
            a, b = text[r.doc_id][r.start_word : r.end_word], text[r.other_doc_id][r.other_start : r.other_end]
            assert r.matches <= D._common(*(np.array([hash(x) for x in w]) for w in (a, b)))
            assert r.matches >= D.SIMILAR * max(len(a), len(b)) and len(a) >= D.LEAST
            assert (r.kind == "copy") == (text[r.doc_id] == text[r.other_doc_id])
            root[find(r.doc_id)] = find(r.other_doc_id)
        holders = {}
        for i, w in rows:
            for at in range(len(w) - D.LEAST + 1):
                holders.setdefault(tuple(w[at : at + D.LEAST]), set()).add(i)
        assert all(len({find(i) for i in held}) == 1 for held in holders.values())
        assert any(len(held) > 1 for held in holders.values())


def test_recall_of_edited_passages(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        core = words(rng, 60)
        other = [f"x{i}-{j}" if j % (10, 12, 16)[i % 3] == 7 else w for j, w in enumerate(core)]
        rows += [(2 * i, words(rng, 40) + core + words(rng, 60)), (2 * i + 1, words(rng, 60) + other + words(rng, 30))]
    rng.shuffle(rows)
    got = D.repeated_passages(table(spark, rows, 6)).collect()
    pairs = {(r.doc_id // 2, r.other_doc_id // 2) for r in got}
    assert all(a == b for a, b in pairs) and len(pairs) >= 108


def test_seeds_of_few_different_words():
    for period in (1, 2, 3, 7):
        w = np.tile(D._mixed(np.arange(1, period + 1, dtype=np.uint64)), 60)[: D.LEAST]
        assert len(D.seeds(w, np.array([0, len(w)]))[0])


def test_long_texts_one_word(spark):
    rows = [(1, ["la"] * 3000), (2, ["la"] * 2500 + ["lo"]), (3, words(random.Random(1), 100)), (4, ["la"] * 44)]
    got = {(r.doc_id, r.other_doc_id) for r in D.repeated_passages(table(spark, rows)).collect()}
    assert got == {(2, 1)}


def test_blobs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        h = np.sort(rng.integers(0, 2**64, n, np.uint64))
        node, at = rng.integers(0, 2**40, n), rng.integers(0, 2**31, n)
        for x, y in zip(D._unblob(D._blob(h, node, at)), (h, node, at), strict=True):
            assert (x == y).all()
