import base64

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import token_counts as C


def plain():
    with open(C.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(enc, text):
    data = (text or "").encode()
    owner = []
    line = 0
    for b in data:
        owner.append(line)
        line += b == 10
    counts, at, crossing = [0] * (line + 1), 0, 0
    for t in enc.encode_ordinary(text or ""):
        n = len(enc.decode_single_token_bytes(t))
        own = owner[at : at + n]
        best = max(sorted(set(own)), key=own.count)
        counts[best] += 1
        crossing += len(set(own)) > 1
        at += n
    return sum(counts), len(counts), crossing, counts


def test_tables_and_edges(spark, sf_dir):
    enc = plain()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1001, None), (1002, ""), (1003, "\n\n\n a\n\n  b \n"), (1003, "<|endoftext|>\né"), (None, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(((r.doc_id, r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) for r in C.count_lines(docs).collect()), key=str)
    assert got == sorted(((d, *brute(enc, t)) for d, t in rows), key=str)
    assert C.count_lines(docs.limit(0)).count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([(1, "a title", "some body", None), (2, None, None, None)], "id long, t string, b string, c string")
    got = {r.id: r for r in C.count_fields(docs, "id", ["t", "b", "c"]).collect()}
    assert got[1].n_sections == 3 and sum(got[1].section_tokens) == got[1].n_tokens > 3
    assert got[2].n_tokens == sum(got[2].section_tokens)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.integers(0, 12), max_size=5), st.sampled_from(["first", "last", "most"]))
def test_rules(sizes, cuts, rule):
    ends = np.cumsum(sizes) if sizes else np.zeros(0, int)
    total = int(sum(sizes))
    borders = np.array([*sorted(c % (total + 1) for c in cuts), total])
    counts, crossing = C.attribute(ends, borders, rule)
    owner = [int(np.searchsorted(borders, b, side="right")) for b in range(total)]
    want, many, at = [0] * len(borders), 0, 0
    for n in sizes:
        own = owner[at : at + n]
        want[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
        many += len(set(own)) > 1
        at += n
    assert counts.tolist() == want and crossing == many
