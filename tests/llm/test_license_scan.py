import random
import re

from sluice.llm import license_scan as L
from sluice.llm.licenses import PHRASES, TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def base(docs):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(docs).collect()), key=str)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert sum(w[2] > 0 for w in want) >= 2
    assert base(docs) == want


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "mit license mit license, MIT\nLicense"), (3, "mit license mit license, MIT\nLicense"), (None, "CC-BY 4.0 cc by cc"),
        (5, "the GNU General Public LicenseX"), (6, "gnu general gnu general public license apache"), (7, "é " * 30000 + "apache license"), (8, "licensé mit licensé"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "1 as row")
    assert base(docs) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert base(docs.limit(0)) == []


def test_long_templates(spark):
    mit = dict(TEXTS)["mit"].split()
    edited = mit[:20] + ["really"] + mit[20:50] + mit[53:]
    rows = [(1, "Some code\n" + " ".join(edited) + "\nend"), (2, " ".join(mit[:15])), (3, "nothing of note here at all")]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.5 <= got[1].score <= 1 and got[1].spans == f"mit:2:{2 + len(edited) + edited.count('and/or') + edited.count('noninfringement')}"
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == ""


def test_numbered_clauses(spark):
    first, second, third = dict(TEXTS)["bsd"].split("Redistributions")
    text = f"{first}1. Redistributions{second}2. Redistributions{third}"
    apart = f"{first} {'word ' * 100} Redistributions{third}"
    docs = spark.createDataFrame([(1, "Some code " + text), (2, apart)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert got[1].labels == "bsd" and got[1].score == 1 and got[1].spans == f"bsd:2:{2 + len(WORD.findall(text))}"
    assert got[2].labels == ""


def test_edited_templates(spark):
    """Every text with words inserted, lost or changed keeps its label; score is the share of words covered."""
    rng, rows, want = random.Random(3), [], {}
    for label, text in TEXTS:
        w = WORD.findall(text.lower())
        middle = len(w) // 2
        edited = [w[:middle] + [f"new{j}" for j in range(n)] + w[middle:] for n in (1, 3, 8, 15)]
        edited += [w[: middle - n // 2] + w[middle + n - n // 2 :] for n in (1, 3, 8, 15) if 4 * n <= len(w)]
        edited += [["x" if i % 12 == 7 else x for i, x in enumerate(w)], [x for i, x in enumerate(w) if i % 12 != 7]]
        for e in edited:
            want[len(rows)] = (label, len(w))
            rows.append((len(rows), " ".join([f"a{rng.randrange(99)}" for _ in range(30)] + e + ["z"] * 20)))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [(want[i], rows[i][1]) for i in want if want[i][0] not in got[i].labels.split(",")]
    assert not lost
    assert all(got[i].score >= 0.7 for i in want)
    assert not any(x in got[i].labels for i in want for x in ("mpl", "unlicense") if want[i][0] != x)


def test_repeated_parts_count_once(spark):
    """A sentence of a template many times over is no more of it than once."""
    mit = WORD.findall(dict(TEXTS)["mit"].lower())
    docs = spark.createDataFrame([(1, " ".join(mit[:25] * 6)), (2, " ".join(mit * 2))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(docs).collect()}
    assert got == {1: ("", 0.0), 2: ("mit", 1.0)}
