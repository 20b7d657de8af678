import re
from collections import Counter

from pyspark.sql import functions as F

from sluice.llm import collocations as C
from sluice.llm import queries as Q


def plainly(rows, least, top=2000, max_n=5):
    """The contract by counters of all phrases."""
    counts, n = {}, Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {(q[i : i + m], a) for q, a in cands.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)}
        kept = []
        for p, a in cands.items():
            if (p, a) not in held:
                score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_counters(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = plainly(rows, 100)
    assert want and rows_of(Q.op13_collocations(spark, sf)) == want


def test_edges(spark, monkeypatch):
    long = "new york city is big, in new york. " * 90_000  # more than a slice
    rows = [(None, None), ("en", None), (None, "A b\tc"), ("und", "a  b C."), ("", "a b c a b c"), ("en", long), ("en", "Ünï cødé; ünï cødé Ünï cødé"), ("fr", "x x x x x x x x"), ("en", "\r\n .,;")]
    rows += [("en", "new york times")] * 40 + [("de", f"der hund {i % 3} läuft schnell\x0bder hund") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "w", "p") for r in rows], "lang string, text string, n int, words string, phrase string")
    for least, max_n in ((2, 5), (3, 3), (40, 4), (1, 2)):
        assert rows_of(C.mine(docs, least=least, max_n=max_n)) == plainly(rows, least, max_n=max_n)
    # a filter of so few bits that it lets everything through gives the same, and so do other batches
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "BATCH_BYTES", 50)
    assert rows_of(C.mine(docs.repartition(5), least=3, top=2)) == plainly(rows, 3, top=2)
    assert C.mine(docs.limit(0)).count() == 0 and C.mine(docs.limit(2)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    counts = [("en", 0, "", 2 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)]
    got = C.scored(spark.createDataFrame(counts, "lang string, words int, phrase string, n long")).collect()
    assert [(r.score, r.l, r.r) for r in got] == [(1000 * big * 2 * big // ((big + 1) * (big + 3)), big + 1, big + 3)]


def test_weaker_absorption(spark):
    rows = [("en", "big red dog")] * 9 + [("en", "big red")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    cands = C.scored(C.phrase_counts(docs, least=5), least=5)
    assert {r.phrase for r in C.unabsorbed(cands).collect()} == {"big red", "big red dog"}
    assert {r.phrase for r in C.unabsorbed(cands, share=90).where(F.col("words") > 1).collect()} == {"big red dog"}
