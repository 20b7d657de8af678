import re
from collections import Counter

from sluice.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The river ran under the old bridge and nobody on the bank said a word about it until morning came again, "


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in Q.judge(docs, ["doc_id"], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (3, " \n\t\n"), (None, "a b c a b c"), (5, "é ü x\n" * 3), (6, "word " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] is None, r[0] or 0), tuple(r[1:])) for r in Q.judge(docs, ["doc_id"], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]).collect())
    assert got == sorted(((i is None, i or 0), brute(t)) for i, t in rows)
    assert Q.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_lines_and_verdict(spark):
    sentence = lambda a: " ".join(f"word{i}" for i in range(a, a + 40)) + "."
    clean = "\n".join([sentence(0), "As.", "It went on.", sentence(80), sentence(120), sentence(40)])
    junk = clean + "\nHome | News | Sport | Weather | Contact | About\nBUY!! NOW!! TODAY!! ONLY!!\nah*** bo### ce$$$ de&&&\nAll rights reserved 2020\nmenu\n" + sentence(40)
    mostly = "\n".join(["x1 | y2 | z3 | w4 | v5 | u6"] * 1 + [f"a{i}*** b{i}### c{i}$$$ d{i}&&&" for i in range(60)]) + "\n" + clean
    docs = spark.createDataFrame([(1, clean, "en", 9), (2, junk, "en", 9), (3, mostly, "en", 9)], "doc_id long, text string, kept string, n_chars long")
    out = {r.doc_id: r for r in Q.filter_documents(docs).collect()}
    assert set(out) == {1, 2}
    assert out[1].text == clean and out[1].n_chars == 9 and out[1].kept == "en"
    assert out[2].text == clean and out[2].n_chars == len(clean)
    got = {r.doc_id: r for r in Q.judge(docs.drop("kept"), ["doc_id"]).collect()}
    assert got[2].cleaned == clean and got[2].n_removed_lines == 6
    assert not got[3].kept
