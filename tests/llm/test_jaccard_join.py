import random
import re

from sluice.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    tried = set()
    for own in by.values():
        for x, i in enumerate(own):
            for j in own[:x]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in J.near_duplicates(docs, **options).collect()), key=str)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_and_edges(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c"), (None, "a b"), (7, " \n"), (7, "q r s t u"), (8, "q r s t u")]
    for i in range(60):  # near copies in a chain and a cloud, wide columns
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(50):  # a passage that many different documents share
        rows.append((300 + i, " ".join(f"d{i}_{j}" for j in range(rng.randint(5, 60))) + " " + passage))
    rows += [(500 + i, rows[20][1]) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 40
    assert got(docs) == want
    assert got(docs, wide=2) == want
    assert got(docs.limit(0)) == []


def test_one_of_each(spark):
    rows = [(9, "a b c d e f", "x"), (4, "a b c d e f", "y"), (5, None, "z"), (6, None, "z"), (7, "other words", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    left = J.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7]


def test_large_groups_are_joined_apart(spark, monkeypatch):
    from sluice.llm import common

    monkeypatch.setattr(common, "SPREAD_LEAST", 3)
    monkeypatch.setattr(common, "SPREAD_SHARE", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, None) for i in range(30)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(400 + i, " ".join(f"d{i}-{j}" for j in range(20))) for i in range(30)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_classes_that_share_half_a_signature(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(5, 9)))) for i in range(80)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows_ = J.prepare(docs, "text", 5, 75)
    half = rows_.withColumn("_s1", J.F.when(J.F.col("_n") > 0, J.F.col("_s1") % 3).otherwise(J.F.lit(0)))
    left = sorted((tuple(r) for r in J._placed(half, "c0", "c1").select("id", "n_shingles", "component_id").collect()), key=str)
    assert left == brute(rows)
