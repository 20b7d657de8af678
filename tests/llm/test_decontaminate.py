import hashlib
import re

import numpy as np

from sluice.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).update([] if i is None else [str(i)])
    sizes = sorted({len(k) for k in windows})
    out = []
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own is not None:
                    hit.update(range(a, a + n))
                    got |= own
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, items, **options):
    found = D.search(D.build_index(docs), items, **options)
    return sorted((tuple(r)[:6] for r in D.report(found).collect()), key=str)


def test_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(w[5] for w in want)
    assert run(docs, items) == want
    assert run(docs, items, block_bytes=1000) == want


def test_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "Alpha beta GAMMA"), (3, "Alpha beta GAMMA"), (None, "x alpha, beta; gamma y"), (7, long), (8, "a b c d e f g h i j k"), (9, "a b c d e"), (11, "only solitary here"), (10, "f g h i j k")]
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (12, "a b c d e f g h i j k"), (5, " ".join(f"w{i}" for i in range(690, 700)) + " w0"), (None, "solitary"), (None, "y")]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(docs, tests) == brute(rows, items)
    assert run(docs.limit(0), tests) == []
    assert all(not r[5] for r in run(docs, tests.limit(0)))
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert run(named, tests) == brute([(d and f"d{d}", t) for d, t in rows], items)
    left = D.remove_contaminated(docs.selectExpr("*", "'q' as segment", "1 as _row", "2 as _ROW_", "3 as id"), tests)
    assert left.columns == ["doc_id", "text", "segment", "_row", "_ROW_", "id"]
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 10, 2, 9]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick very brown fox"), (2, "the brown quick cow")], "doc_id long, text string")
    items = spark.createDataFrame([(4, "the quick brown fox")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near_items) for r in D.report(D.search(D.build_index(docs), items)).collect()}
    assert got == {1: (False, 1), 2: (False, 0)}


def test_candidates_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    positions = rng.permutation(300).astype(np.int32)
    counts = np.full(6, 50, np.int32)
    positions = np.concatenate([np.sort(p) for p in positions.reshape(6, 50)])
    windows = rng.integers(0, 6, (400, 3)).astype(np.int32)
    given = (windows, np.arange(6), np.arange(6), np.arange(6) * 50, counts, positions, 1)
    whole = D.intersect(*given)
    assert len(whole[0])
    for step in (1, 60, 777):
        monkeypatch.setattr(D, "CANDIDATES", step)
        assert all((x == y).all() for x, y in zip(whole, D.intersect(*given), strict=True))
