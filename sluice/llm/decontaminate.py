"""Benchmark decontamination with a distributed positional inverted index.

1. ``build_index`` stores the postings of every training word: each row is a
   segment of a few megabytes of documents with its sorted term dictionary and,
   term by term, the ascending word positions.  Segments are bounded by text
   size, so no term, document or source can make one large.
2. The test terms' frequencies over all segments are summed (at most one row
   per test term of a block).
3. For each window of a test item the posting list of its globally rarest term
   gives candidate places; the lists of its other terms, ascending in
   frequency, are shifted by their offsets and intersected with them.  Terms
   that a segment lacks discard their windows at once.  With ``slop`` a term
   may stand that many words off its place: a proximity match.

Only the index build reads the texts.  Test items are taken in blocks of a
stated byte size, so what goes to the executors is bounded whatever the
benchmark's size, and candidate places are taken in steps; a block is one more pass over the index, not a pairing.

Defined results: null or empty texts have no words and are never hit; an item
without words never matches; an item with fewer words than a window is one
window; repeated document rows each get their own result row; repeated item
ids count once per document; an item without an id hits words like any other
and contaminates, but has no place among the counted ids; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ALNUM, drop_stored, pack, slices, stored, text_buffer, unpack, word_bounds, word_hashes

WINDOW = 10
SLOP = 2
SEGMENT_BYTES = 4 << 20
#: Bytes of test items whose windows are broadcast at once.
BLOCK_BYTES = 8 << 20

#: Candidate places that are held at once.
CANDIDATES = 1 << 18


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for no, batch in enumerate(slices(batches, "text", SEGMENT_BYTES)):
        data, offsets = text_buffer(batch.column("text"))
        starts, ends, ptr = word_bounds(data, offsets, ALNUM)
        words = word_hashes(data, starts, ends)
        order = np.argsort(words, kind="stable").astype(np.int32)
        ordered = words[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(ordered)]])).astype(np.int32)
        steps = np.diff(order, prepend=np.int32(0)).astype(np.int32)
        ids = batch.column("id")
        cells = [pack(ptr.astype(np.int64)), pack(ordered[first]), pack(counts), pack(steps)]
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + no], pa.int64()), own, *[pa.array([c], pa.binary()) for c in cells]], names=["segment", "doc_ids", "doc_ptr", "terms", "counts", "positions"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of ``docs``, a row per segment; ids keep their type."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return stored(source.mapInArrow(_segments, f"segment long, doc_ids array<{kind}>, doc_ptr binary, terms binary, counts binary, positions binary"), "postings")


def _words_of(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    starts, ends, ptr = word_bounds(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    return [words[a:b] for a, b in itertools.pairwise(ptr)]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, streamed to the driver partition by partition, in blocks of bounded size."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _windows(block: list[tuple[str | None, str]], window: int) -> tuple[list[str | None], np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Item ids, the block's terms, and by length the windows as term numbers with their items."""
    items = sorted({i for i, _ in block}, key=lambda i: (i is None, i))
    number = {i: k for k, i in enumerate(items)}
    words = _words_of([t for _, t in block])
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    by: dict[int, list] = {}
    for (i, _), w in zip(block, words, strict=True):
        if len(w):
            n = min(window, len(w))
            by.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocabulary, w), n), number[i]))
    out = {}
    for n, found in by.items():
        rows = np.concatenate([np.column_stack([v, np.full(len(v), k)]) for v, k in found])
        rows = np.unique(rows, axis=0)
        out[n] = (rows[:, :n].astype(np.int32), rows[:, n].astype(np.int32))
    return items, vocabulary, out


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary.value
    total = np.zeros(len(vocab), np.int64)
    for batch in batches:
        for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
            have, n = unpack(terms.as_py(), np.uint64), unpack(counts.as_py(), np.int32)
            at = np.searchsorted(have, vocab)
            ok = at < len(have)
            ok[ok] = have[at[ok]] == vocab[ok]
            total[ok] += n[at[ok]]
    known = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(total[known], pa.int64())], names=["term", "n"])


def intersect(windows: np.ndarray, rarity: np.ndarray, local: np.ndarray, first: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``windows`` in one segment: window number, start, and whether every term is at its exact place.

    ``local`` gives each test term's number in the segment (-1: absent),
    ``first``/``counts`` its posting list in ``positions``.
    """
    alive = np.flatnonzero((local >= 0)[windows].all(axis=1))
    if not len(alive):
        return alive, alive, alive.astype(bool)
    order = np.argsort(rarity[windows[alive]], axis=1, kind="stable")
    terms = np.take_along_axis(local[windows[alive]], order, axis=1)
    candidates = counts[terms[:, 0]].astype(np.int64)
    total = np.cumsum(candidates)
    width = np.int64(1) << np.int64(32)
    keyed = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * width + positions
    found = []
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CANDIDATES, side="right")))
        n = candidates[low:high]
        who = low + np.repeat(np.arange(high - low), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = positions[first[terms[who, 0]] + inner].astype(np.int64) - order[who, 0]
        exact = np.ones(len(who), bool)
        for j in range(1, windows.shape[1]):
            wanted = terms[who, j] * width + start + order[who, j]
            at = np.searchsorted(keyed, wanted)
            above = keyed[np.minimum(at, len(keyed) - 1)]
            below = keyed[np.maximum(at - 1, 0)]
            hit = above == wanted
            near = hit | (np.abs(above - wanted) <= slop) | (np.abs(wanted - below) <= slop)
            who, start, exact = who[near], start[near], (exact & hit)[near]
            if not len(who):
                break
        found.append((alive[who], start, exact))
        low = high
    who, start, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    return who, start, exact


def _search(batches: Iterator[pa.RecordBatch], query, slop: int) -> Iterator[pa.RecordBatch]:
    items, vocab, rarity, by = query.value
    for batch in batches:
        for no in range(batch.num_rows):  # one segment's lists at a time
            row = {c: batch.column(c)[no].as_py() for c in ("segment", "doc_ptr", "terms", "counts", "positions")}
            ids, ptr = batch.column("doc_ids")[no].values, unpack(row["doc_ptr"], np.int64)
            have, counts = unpack(row["terms"], np.uint64), unpack(row["counts"], np.int32)
            positions = np.cumsum(unpack(row["positions"], np.int32), dtype=np.int32)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
            local = np.full(len(vocab), -1, np.int64)
            at = np.searchsorted(have, vocab)
            ok = at < len(have)
            ok[ok] = have[at[ok]] == vocab[ok]
            local[ok] = at[ok]
            docs = len(ids)
            found: list[tuple[np.ndarray, ...]] = []
            for n, (windows, item) in by.items():
                which, start, exact = intersect(windows, rarity, local, first, counts, positions, slop)
                doc = np.searchsorted(ptr, start, side="right") - 1
                inside = (start >= 0) & (doc < docs)
                inside[inside] &= start[inside] + n <= ptr[doc[inside] + 1]
                found.append((doc[inside], start[inside] - ptr[doc[inside]], np.full(int(inside.sum()), n), item[which[inside]], exact[inside]))
            doc, start, size, item, exact = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
            order = np.lexsort((start, doc))
            doc, start, size, item, exact = doc[order], start[order], size[order], item[order], exact[order].astype(bool)
            edge = np.searchsorted(doc, np.arange(docs + 1))
            spans, names, nearby = [], [], []
            for i in range(docs):
                part = slice(edge[i], edge[i + 1])
                if edge[i] == edge[i + 1]:
                    spans.append([])
                    names.append([])
                    nearby.append([])
                    continue
                full = exact[part]
                spans.append(merged(start[part][full], size[part][full]))
                names.append([items[k] for k in np.unique(item[part][full]) if items[k] is not None])
                nearby.append([items[k] for k in np.unique(item[part][~full]) if items[k] is not None])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(docs, row["segment"]), pa.int64()), pa.array(np.arange(docs), pa.int32()),
                    ids, pa.array(np.diff(ptr), pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), pa.array(nearby, pa.list_(pa.string())),
                ],
                names=["segment", "ordinal", "doc_id", "n_words", "spans", "items", "near"],
            )


def merged(start: np.ndarray, size: np.ndarray) -> list[int]:
    """Ascending, disjoint start, end, start, end, ... of the words that the windows cover."""
    out: list[int] = []
    for a, n in sorted(zip(start.tolist(), size.tolist(), strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], a + n)
        else:
            out += [a, a + n]
    return out


_FOUND = "segment long, ordinal int, doc_id {}, n_words long, spans array<int>, items array<string>, near array<string>"


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per indexed document: doc_id, n_words, spans (start, end, ... in words), items, near.

    ``items`` have an exact window in the document; ``near`` only, or also, a
    proximity match.
    """
    spark = index.sparkSession
    schema = _FOUND.format(index.schema["doc_ids"].dataType.elementType.simpleString())
    parts = []
    for block in _blocks(items, id_col, text_col, block_bytes):
        names, vocab, by = _windows(block, window)
        terms = spark.sparkContext.broadcast(vocab)
        rarity = np.zeros(len(vocab), np.int64)
        seen = index.select("terms", "counts").mapInArrow(lambda b, t=terms: _frequencies(b, t), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in seen.collect():
            rarity[r.term] = r.n
        query = spark.sparkContext.broadcast((names, vocab, rarity, by))
        parts.append(index.mapInArrow(lambda b, q=query: _search(b, q, slop), schema))
    if not parts:
        query = spark.sparkContext.broadcast(([], np.zeros(0, np.uint64), np.zeros(0, np.int64), {}))
        parts = [index.mapInArrow(lambda b, q=query: _search(b, q, slop), schema)]
    if len(parts) == 1:
        return parts[0].drop("segment", "ordinal")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )
    return one.drop("segment", "ordinal")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, counts, digests, near = [], [], [], []
        for spans, items, close in zip(*(batch.column(c).to_pylist() for c in ("spans", "items", "near")), strict=True):
            a = np.asarray(spans[0::2], np.int64)
            m = merged(a, np.asarray(spans[1::2], np.int64) - a) if spans else []
            hits.append(sum(m[1::2]) - sum(m[0::2]))
            counts.append(len(items))
            digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            near.append(len(set(close) - set(items)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array([h > 0 for h in hits]), pa.array(near, pa.int64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"],
        )


def report(found: DataFrame) -> DataFrame:
    """A row per document with counts and the digest of its items."""
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_reported, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without an exact benchmark window; all columns.

    Rows are matched by a row number carried through the index, so repeated or
    null ids are told apart.
    """
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    index = build_index(numbered, row, text_col)
    hit = stored(search(index, items, slop=0).where(F.size("spans") > 0).select("doc_id"), "hit")
    drop_stored(index)
    return numbered.join(hit, numbered[row] == hit["doc_id"], "left_anti").drop(row)
