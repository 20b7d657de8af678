import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing as P


def expected(rows, capacity):
    t = Tokenizer.from_file(P.tokenizer_path())
    out = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for no, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((d, no, at, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
    return sorted(out, key=str)


def holds(rows, got, capacity):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected(rows, capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = P.pack(docs).collect()
    n = holds(rows, got, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "It's 2 o'clock, don't. Now!! x. 9, é. ß, <|endoftext|>a.b ..,, Á \x1c z\x85y İI"), (3, "same"), (3, "same"), (None, "same, Same."), (6, "word " * 9000), (7, "１２, ½. ー. Ⅷ, x́."), (8, "!!, a_, b\x1cc\x1dd Σας ΣΑΣ. it's, 'tis. ½, ²."), (9, "__, x.. y,, z.\nEnd.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as length", "'q' as piece")
    holds(rows, P.pack(docs).collect(), 2048)
    holds(rows, P.pack(docs, capacity=16).collect(), 16)
    assert P.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 40))
def test_fullest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    own = P.fullest(counts, room)
    assert sum(own) == max(s for s in sums if s <= room)
    assert all(own.count(n) <= counts[n] for n in own)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_patterns_use_every_piece_once(histogram):
    used = defaultdict(int)
    for lengths, times in P.patterns(histogram, 64):
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert dict(used) == histogram


def fuzzed(rng, n):
    """Words of letters of all Unicode, those with longer lower cases often, with punctuation and marks around."""
    letters = [c for c in map(chr, [*range(0x41, 0x2000), *range(0xA640, 0xA800), *range(0xFB00, 0xFB10)]) if c.isalpha()]
    longer = [c for c in map(chr, range(0x110000)) if len(c.lower()) > 1 or len(c.upper()) > 1]
    near = [*map(chr, range(0x41, 0x180))]
    mixed = [*",.;:!?'\"-_() \n\ṫ́‍", "İ", "İ", "I", "ı"]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice([letters, longer, near, mixed, mixed])) for _ in range(rng.randrange(1, 14)))


def test_token_ids_of_any_letters():
    tokenizer, own = Tokenizer.from_file(P.tokenizer_path()), P.WordEncoder(P.tokenizer_path())
    texts = ["İ,", "GELDİ, GİTTİ.", "İ.", "aİ!b", "İİ--", "\u0a5b?", "\u0958,", *fuzzed(random.Random(2), 20_000)]
    for x, e in zip(own.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == e.ids


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    rows = [(i // 3, "one two three") for i in range(900)] + [(5000 + i, "word " * (i % 7)) for i in range(200)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=16).collect()
    holds(rows, got, 16)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
