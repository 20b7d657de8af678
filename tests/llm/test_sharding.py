import zlib
from collections import Counter, defaultdict

from sluice.llm import sharding as S


def holds(rows, got, shards=16):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots, size = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = S.assign(docs).collect()
    size = holds(rows, got)
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(abs(v - mean) for v in size.values()) < 40_000
    home, n = defaultdict(set), Counter(t for _, t in rows)
    text = dict(rows)
    for r in got:
        home[text[r.doc_id]].add(r.shard)
    assert all(len(home[t]) == 1 for t in n if n[t] * (len(t.encode()) + 1) * 16 * S.GROUP_PART <= sum(size.values()))


def test_hot_text_and_edges(spark):
    rows = [(i, "same text here" if i % 3 else f"own {i} " * (i % 50)) for i in range(6000)] + [(None, None), (1, ""), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard")
    size = holds(rows, S.assign(docs, sample=4000).collect())
    mean = sum(size.values()) / 16
    assert max(abs(v - mean) for v in size.values()) <= mean / S.GROUP_PART + 500
    assert S.assign(docs.limit(0)).count() == 0
    assert S.assign(docs.limit(1)).count() == 1
