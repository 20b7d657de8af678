import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sluice.llm import infilling as I
from sluice.llm import queries as Q


def plainly(doc_id, text):
    """The contract's row, by slices of the text."""
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", a, b - a, "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_against_slices(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        *head, output = plainly(r.doc_id, r.text)
        want[r.doc_id] = (*head, sha(output), sha(r.text or ""))
    got = Q.op11_infilling(spark, sf).collect()
    assert len(got) == len(rows)
    assert {tuple(r)[0]: tuple(r)[1:] for r in got} == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_edges(spark):
    long = "wört 😀 " * 700_000  # more than two slices
    texts = [None, "", "a", "<P", "x<S>y", "<<P>", "é\n\r\n\t\x00  z", "a<M", "<S", "S><P", long, "same", "same"]
    rows = [(i, t, 7, "form", "out") for i, t in enumerate(texts)] * 2 + [(100 + i, "<P" * (i % 7) + "ab" * i, 0, "", "") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string")
    out = I.transform(docs)
    got = out.withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.doc_id != 10 and r.form != "plain") == sorted((i, *plainly(i, t)) for i, t, *_ in rows if i != 10 and plainly(i, t)[1] != "plain")
    text = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.back == text[r.doc_id] for r in got)
    assert I.transform(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "some text"), (None, None)], "doc_id long, text string")
    assert sorted(r.n for r in I.transform(odd).collect()) == [0, 9]


def test_words_and_other_marks(spark):
    docs = spark.createDataFrame([(i, "  one two\n three " * (i % 9)) for i in range(200)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    for unit in (I.WORD, I.LINE):
        out = I.transform(docs, unit=unit, sentinels=marks, rearranged=100, suffix_first=50)
        got = out.withColumn("back", I.restored(F.col("output"), F.col("form"), marks)).collect()
        for r in got:
            text = "  one two\n three " * (r.doc_id % 9)
            ends = [0, *(m.end() for m in re.finditer(unit, text))]
            assert r.back == text and r.n == len(ends) - 1
            assert not text or (r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends)
    for wrong in (("", "b", "c"), ("<a", "a<", "x"), ("aa", "aab", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            I.transform(docs, sentinels=wrong)


def test_matches_are_lazy():
    taken = []

    def matches():
        for m in re.finditer(".", "abcdefghij"):
            taken.append(m.start())
            yield m

    assert I.ends_at(matches(), (2, 5)) == (2, 5) and taken == [0, 1, 2, 3, 4]
    assert I.ends_at(iter(()), (0, 0)) == (0, 0) and I.counted(re.finditer("x", "")) == 0
