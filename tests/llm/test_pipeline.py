"""The pipeline against a plain version of each stage on small tables."""

import re

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as components
from test_packing import holds

from sluice.llm import pii, quality_rules


def brute(rows, items):
    """(doc_id, text) rows after the first four stages."""
    kept = []
    for d, text in rows:
        stay, _, gone, chars = quality_rules.judged_lines((text or "").encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else {g for g in grams if grams.count(g) > 1}
        covered = {j for i, g in enumerate(grams) if g in seen for j in (i, i + 1, i + 2)}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and chars >= quality_rules.MIN_KEPT * sum(map(len, words)):
            kept.append((d, "\n".join(x.decode() for x in stay) if gone else text))
    first = {}
    for (d, text), (_, n, c) in zip(sorted(kept), sorted(components(sorted(kept))), strict=True):
        if n == 0 or c == d:
            first[d] = text
    clean = {r[0] for r in contaminated(list(first.items()), items) if not r[5]}
    trees, thresholds = pii.model()
    return [(d, pii.redact(t, pii.find(t, trees, thresholds))) for d, t in first.items() if d in clean]


def test_stages_keep_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
    got = now.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)
    holds(want, corpus_pipeline.run(spark, sf_dir).collect(), 2048)


def test_hostile_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, an empty table and columns named like the operators' own."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, "s", None), (None, "mit license " * 200, "en", None, 5)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _row string, node string, kept string, changed string, segment string"
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w", "v") for r in rows], columns)
    spark.createDataFrame([(1, "gnu"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, str(tmp_path))
            out.collect()
