"""Fuzzy repeated passages by collinear chaining.

1. Seeds are pairs of word ``M``-mers: an M-mer and, of the ``REACH`` M-mers
   after it, the one whose hash is nearest to its own.  They are as specific as
   ``2 * M`` words in a row but bridge an edit between their halves.  Every
   third seed is kept, chosen by its hash alone, so that two texts keep the same
   ones; where ``SPREAD`` seeds in a row would all go, the least stays, so any
   ``LEAST`` words in a row hold a kept seed.
2. A task takes its texts in blocks of bounded size.  In a block every other
   place of a seed is matched with the seed's first place, and a seed leaves the
   block once: a key that very many rows hold is at most a row per block.
3. Seeds meet by hash range over all blocks, and each block's place is matched
   with the first place of all.
4. By pair of documents, matches on one diagonal become segments, and segments
   are chained: the best predecessor ends before in both texts, and its score
   less a cost for both gaps comes from a Fenwick tree of prefix maxima.
5. Chains are aligned to the texts: ends are extended over equal words and
   small edits to the point where the likeness of what was added is best, gaps
   between segments are aligned exactly, and passages of at least ``LEAST``
   words and ``SIMILAR`` likeness are returned.  A chain that is less alike is
   cut at its widest gap and its parts are judged again, down to single
   segments.
6. A place that no passage covers is open: the seed's first place may hold a
   part of a passage only.  Windows of ``LEAST`` words around open places go
   through 2 to 5 once more with the whole window as the seed.  A window with a
   seed that no other document holds cannot repeat and is left out.  So
   verbatim passages are linked whatever a seed's first place holds.

Every copy of a passage is linked to a first place, of its block or of all, so
groups cost a row per member, and the links give the classes.  Equal texts are
one passage over the whole, of kind "copy".

Defined results: null and empty texts and texts shorter than ``LEAST`` words
have no passages; a passage that repeats only inside one document is not
returned; repeated rows are equal texts; ties of place go to the row read
first in a block and to the smaller row number between blocks; an empty table
gives an empty table.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.llm.common import _CHAIN, ALNUM, _mixed, drop_stored, gathered, pack, stored, text_buffer, unpack, window_hashes, window_ok, word_bounds, word_hashes
from sluice.llm.meeting import meet, runtime_filter

#: Words of each half of a seed, places its second half is chosen from, words a seed lies within.
M, REACH = 4, 8
EXTENT = 2 * M + REACH - 1
#: Least words of a passage, least share of its words that match.
LEAST, SIMILAR = 45, 0.8
#: One seed of this many is kept, and one of any SPREAD in a row.
KEPT, SPREAD = 3, LEAST - EXTENT + 1
#: Matches of one diagonal at most this many words apart are one segment.
JOINED = 26
#: Cost of a word of gap in a chain.
GAP_COST = 0.5
#: Edits that an end is extended over: words of both texts, and equal words that must follow, more after larger edits.
_EDITS = sorted(((x, y, 2 if x + y <= 2 else 3 if x + y <= 6 else 5) for x in range(7) for y in range(7) if x or y), key=lambda e: (e[0] + e[1], abs(e[0] - e[1])))
#: Bytes of text in a block of a task, and in a hash range on average.
BLOCK_BYTES = 16 << 20
GROUP = 300

Keys = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def seeds(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the kept seeds, and the word each begins with."""
    halves = window_hashes(words, M)
    n = max(len(words) - EXTENT + 1, 0)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for j in range(REACH):
        np.minimum(least, halves[:n] ^ halves[M + j : M + j + n], out=least)
    key = _mixed(halves[:n] * _CHAIN + (least ^ halves[:n]))
    kept = key % np.uint64(KEPT) == 0
    if n >= SPREAD:
        total = np.concatenate([[0], np.cumsum(kept)])
        bare = np.flatnonzero((total[SPREAD:] == total[:-SPREAD]) & window_ok(ptr, LEAST))
        for at in (bare[i : i + 65536] for i in range(0, len(bare), 65536)):
            kept[at + np.lib.stride_tricks.sliding_window_view(key, SPREAD)[at].argmin(axis=1)] = True
    at = np.flatnonzero(kept & window_ok(ptr, EXTENT))
    return key[at], at


def seed_keys(batch: pa.RecordBatch, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return seeds(words, ptr)


def window_keys(batch: pa.RecordBatch, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``LEAST`` words that hold an open place and no seed that only their document holds."""

    def places(name: str) -> np.ndarray:
        col = batch.column(name)
        return np.repeat(ptr[:-1], np.asarray(col.value_lengths(), np.int64)) + np.asarray(col.flatten(), np.int64)

    def within(at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))])
        return total[SPREAD : SPREAD + len(hashes)] - total[: len(hashes)]

    hashes = window_hashes(words, LEAST)
    at = seeds(words, ptr)[1]
    alone = at[~np.isin(at, places("shared"))]
    at = np.flatnonzero((within(alone) == 0) & (within(places("open")) > 0) & window_ok(ptr, LEAST))
    return hashes[at], at


def chain(su: np.ndarray, sv: np.ndarray, size: np.ndarray, cost: float = GAP_COST, overlap: int = M) -> list[list[int]]:
    """Collinear chains of segments (start in u, start in v, words), best first.

    A segment's score is its size plus the best of 0 and a predecessor's score
    less ``cost`` times the words between them in both texts.  Predecessors
    must end before it in both (up to ``overlap`` words).  The Fenwick tree is
    indexed by end in v and holds score + cost * (end in u + end in v).
    """
    n = len(su)
    inner = np.minimum(size, overlap)
    eu, ev = su + size - inner, sv + size - inner
    rank = {e: i + 1 for i, e in enumerate(np.unique(ev).tolist())}
    ends = np.unique(ev)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, back = size.astype(float), np.full(n, -1)
    waiting: list[tuple[int, int]] = []
    for i in np.lexsort((sv, su)).tolist():
        while waiting and waiting[0][0] <= su[i]:
            j = heapq.heappop(waiting)[1]
            entry, at = (score[j] + cost * float(eu[j] + ev[j]), j), rank[int(ev[j])]
            while at < len(tree):
                if entry > tree[at]:
                    tree[at] = entry
                at += at & -at
        best, at = (-1e18, -1), int(np.searchsorted(ends, sv[i], side="right"))
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - cost * float(su[i] + sv[i])
        if best[1] >= 0 and gain > 0:
            score[i] += gain
            back[i] = best[1]
        heapq.heappush(waiting, (int(eu[i]), i))
    used = np.zeros(n, bool)
    out = []
    for i in sorted(range(n), key=lambda x: -score[x]):
        if used[i]:
            continue
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = int(back[i])
        out.append(own[::-1])
    return out


def _segments(pu: np.ndarray, pv: np.ndarray, size: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of ``size`` words on one diagonal, each within reach of the one before, as segments."""
    order = np.lexsort((pu, pu - pv))
    pu, pv = pu[order], pv[order]
    cut = np.concatenate([[True], (np.diff(pu - pv) != 0) | (np.diff(pu) > JOINED)])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(pu)]]) - 1
    return pu[first], pv[first], pu[last] - pu[first] + size


def _extend(a: np.ndarray, b: np.ndarray, edits: list[tuple[int, int, int]] = _EDITS) -> tuple[int, int, int]:
    """How far equal starts of a and b go over isolated edits: words of a, of b, and matches.

    Of the ends of equal runs on the way, the one with the most matches beyond ``SIMILAR`` of the words.
    """
    i = j = same = 0
    best, most = (0, 0, 0), 0.0
    while True:
        n = min(len(a) - i, len(b) - j)
        run, step = 0, 32
        while run < n:  # runs are short, so look a little way ahead first
            diff = np.flatnonzero(a[i + run : i + min(run + step, n)] != b[j + run : j + min(run + step, n)])
            if len(diff):
                run += int(diff[0])
                break
            run, step = min(run + step, n), step * 8
        i, j, same = i + run, j + run, same + run
        if same - SIMILAR * max(i, j) >= most - 1e-9:
            best, most = (i, j, same), same - SIMILAR * max(i, j)
        for x, y, n in edits:
            if i + x + n <= len(a) and j + y + n <= len(b) and a[i + x] == b[j + y] and (a[i + x : i + x + n] == b[j + y : j + y + n]).all():
                same += int((a[i : i + x] == b[j : j + y]).sum()) if x == y else 0
                i, j = i + x, j + y
                break
        else:
            return best


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of b and all words of a at a time in one integer's bits."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    unmatched = full
    for x in b.tolist():
        hit = unmatched & where.get(x, 0)
        unmatched = ((unmatched + hit) | (unmatched - hit)) & full
    return len(a) - unmatched.bit_count()


def passages(a: np.ndarray, b: np.ndarray, pu: np.ndarray, pv: np.ndarray, size: int = M) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages (start, end, other start, other end, matches) of word arrays a and b from matches of ``size`` words."""
    su, sv, size = _segments(pu, pv, size)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[tuple[int, int, int, int], int] = {}

    def inside(x: tuple[int, ...]) -> bool:
        return any(p[0] <= x[0] and x[1] <= p[1] and p[2] <= x[2] and x[3] <= p[3] for p in out)

    waiting = chain(su, sv, size)[::-1]
    while waiting:
        own = waiting.pop()
        u, v = int(su[own[0]]), int(sv[own[0]])
        if inside((u, int(su[own[-1]] + size[own[-1]]), v, int(sv[own[-1]] + size[own[-1]]))):
            continue
        left, other, matches = _extend(a[:u][::-1], b[:v][::-1])
        start, ostart, i, j = u - left, v - other, u, v
        for s in own:
            x, y = int(su[s]), int(sv[s])
            if x > i or y > j:
                x, y = max(x, i), max(y, j)
                if (i, x, j, y) not in gaps:
                    gaps[i, x, j, y] = _common(a[i:x], b[j:y])
                matches += gaps[i, x, j, y]
            i, j = x, y
            end = int(su[s] + size[s])
            if end > i:
                n = min(end - i, len(a) - i, len(b) - j)
                matches += int((a[i : i + n] == b[j : j + n]).sum())
                i, j = i + n, j + n
        right, oright, more = _extend(a[i:], b[j:])
        passage = (start, i + right, ostart, j + oright, matches + more)
        words = max(passage[1] - passage[0], passage[3] - passage[2])
        if passage[4] < SIMILAR * words and len(own) > 1:
            at = np.asarray(own)
            cut = int(np.argmax(np.diff(su[at]) + np.diff(sv[at]) - 2 * size[at[:-1]])) + 1
            waiting += [own[cut:], own[:cut]]
            continue
        if passage[4] < SIMILAR * words:  # edits at its ends, so the equal words alone
            left, right = _extend(a[:u][::-1], b[:v][::-1], [])[0], _extend(a[u:], b[v:], [])[0]
            words = left + right
            passage = (u - left, u + right, v - left, v + right, words)
        if passage[1] - passage[0] >= LEAST and passage[4] >= SIMILAR * words and not inside(passage):
            out.append(passage)
    return sorted(out)


_PASSAGE = ["start_word", "end_word", "other_start", "other_end", "matches"]


def _judged(u: int, v: int, a: np.ndarray, b: np.ndarray, pu: np.ndarray, pv: np.ndarray) -> list[tuple[int, ...]]:
    """Rows (u, v, passage, whether it is the whole of two equal texts)."""
    return [(u, v, *p, p == (0, len(a), 0, len(b), len(a)) and len(a) == len(b)) for p in passages(a, b, pu, pv)]


def _aligned(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    found: list[tuple[int, ...]] = []
    if rows.num_rows and pairs.num_rows:
        data, offsets = text_buffer(rows.column("text"))
        starts, ends, ptr = word_bounds(data, offsets, ALNUM)
        every = word_hashes(data, starts, ends)
        words = {node: every[x:y] for node, (x, y) in zip(rows.column("node").to_pylist(), itertools.pairwise(ptr.tolist()), strict=True)}
        for u, v, met in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), pairs.column("seeds"), strict=True):
            pu, pv = (np.asarray(met.values.field(i), np.int64) for i in (0, 1))
            found += _judged(u, v, words[u], words[v], pu, pv)
    columns = {c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(["u", "v", *_PASSAGE])}
    return pa.table({**columns, "whole": pa.array([f[-1] for f in found], pa.bool_())})


def _first_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending hashes: the index of each one's first, and where they begin."""
    begins = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(begins)
    return np.repeat(first, np.diff(np.concatenate([first, [len(h)]]))), begins


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of integers, first bytes first, so that equal ones stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def _blob(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Ascending hashes with the documents and places they stand at."""
    docs, local = np.unique(doc, return_inverse=True)
    parts = (docs.astype(np.int64), _planes(np.diff(h, prepend=np.uint64(0))), _planes(local.astype(np.uint32)), _planes(at.astype(np.uint32)))
    return struct.pack("<q", len(h)) + pack(np.frombuffer(b"".join(p.tobytes() for p in parts), np.uint8))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    raw = unpack(blob[8:], np.uint8)
    cut = len(raw) - 16 * n

    def whole(first: int, width: int, kind: type) -> np.ndarray:
        return np.ascontiguousarray(raw[cut + first * n : cut + (first + width) * n].reshape(width, n).T).view(kind).ravel()

    return np.cumsum(whole(0, 8, np.uint64), dtype=np.uint64), raw[:cut].view(np.int64)[whole(8, 4, np.uint32)], whole(12, 4, np.uint32).astype(np.int64)


_BLOCK = "bucket int, blob binary, u long, v long, start_word long, end_word long, other_start long, other_end long, matches long, whole boolean, shared array<int>, open array<int>"
_BLOCK_ARROW = pa.schema(
    [("bucket", pa.int32()), ("blob", pa.binary()), *((c, pa.int64()) for c in ("u", "v", *_PASSAGE)), ("whole", pa.bool_()), ("shared", pa.list_(pa.int32())), ("open", pa.list_(pa.int32()))]
)


def _rows(**columns: list | pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    cells = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCK_ARROW]
    return pa.RecordBatch.from_arrays(cells, schema=_BLOCK_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch], keys: Keys, bits: int) -> Iterator[pa.RecordBatch]:
    """Of every block: its seeds by hash range, the passages inside it, and its documents' shared and open places."""
    for batch in gathered(batches, "text", BLOCK_BYTES):
        data, offsets = text_buffer(batch.column("text"))
        starts, ends, ptr = word_bounds(data, offsets, ALNUM)
        words = word_hashes(data, starts, ends)
        del data, starts, ends
        node = np.asarray(batch.column("node"), np.int64)
        h, place = keys(batch, words, ptr)
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        row = np.searchsorted(ptr, place, side="right") - 1
        first, begins = _first_of(h)
        at = place - ptr[row]

        met = np.flatnonzero(row != row[first])
        met = met[np.lexsort((row[first[met]], row[met]))]
        u, v = row[met], row[first[met]]
        cuts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])).tolist() if len(met) else []
        found: list[tuple[int, ...]] = []
        covered = np.zeros(len(words) + 1, np.int32)
        for x, y in itertools.pairwise([*cuts, len(met)]):
            i, j = int(u[x]), int(v[x])
            for p in _judged(i, j, words[ptr[i] : ptr[i + 1]], words[ptr[j] : ptr[j + 1]], at[met[x:y]], at[first[met[x:y]]]):
                found.append((int(node[i]), int(node[j]), *p[2:]))
                covered[ptr[i] + p[2]] += 1
                covered[ptr[i] + p[3]] -= 1
        if found:
            yield _rows(**{c: [f[i] for f in found] for i, c in enumerate(["u", "v", *_PASSAGE, "whole"])})

        edges = np.concatenate([np.flatnonzero(np.diff((h[begins] >> np.uint64(64 - bits)).astype(np.int64))) + 1, [int(begins.sum())]]) if len(h) else []
        hb, nb, ab = h[begins], node[row[begins]], at[begins]
        low = 0
        for high in edges:
            yield _rows(bucket=[int(hb[low] >> np.uint64(64 - bits))], blob=[_blob(hb[low:high], nb[low:high], ab[low:high])])
            low = int(high)

        if len(met):
            inside = np.cumsum(covered) > 0
            several = np.zeros(len(h), bool)
            several[met] = several[first[met]] = True
            opened = np.zeros(len(h), bool)
            opened[met] = ~(inside[place[met]] & inside[place[met] + M - 1])
            shared = np.sort(place[several[first]])
            opened = np.sort(place[opened])
            who = np.unique(np.searchsorted(ptr, shared, side="right") - 1)

            def of_rows(places: np.ndarray, who: np.ndarray = who, ptr: np.ndarray = ptr) -> pa.Array:
                own = np.searchsorted(ptr, places, side="right") - 1
                ends = np.concatenate([[0], np.searchsorted(own, who, side="right")])
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places - ptr[own], pa.int32()))

            yield _rows(u=node[who], shared=of_rows(shared), open=of_rows(opened))


def _across(table: pa.Table) -> pa.Table:
    """Matches (u, v, pu, pv) of one hash range: each block's place of a seed with the first of all."""
    parts = [_unblob(b) for b in table.column("blob").to_pylist()]
    h, node, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, h))
    h, node, at = h[order], node[order], at[order]
    first, _ = _first_of(h)
    met = np.flatnonzero(node != node[first])
    first = first[met]
    return pa.table({"u": node[met], "v": node[first], "pu": pa.array(at[met], pa.int32()), "pv": pa.array(at[first], pa.int32())})


_MET = "u long, v long, start_word long, end_word long, other_start long, other_end long, matches long, whole boolean"


def _linked(rows: DataFrame, texts: DataFrame, keys: Keys, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages inside and across blocks; pairs that met across; shared and open places of documents inside blocks."""
    local = stored(rows.mapInArrow(lambda b: _blocks(b, keys, bits), _BLOCK), "blocks")  # kept: its passages are read by the caller
    reps = local.where("bucket is not null").select("bucket", "blob")
    matches = stored(reps.groupBy("bucket").applyInArrow(_across, "u long, v long, pu int, pv int"), "matches")
    pairs = stored(matches.groupBy("u", "v").agg(F.collect_list(F.struct("pu", "pv")).alias("seeds")), "seeds")
    drop_stored(matches)
    found = meet(pairs, texts, _aligned, _MET, GROUP)
    inner = local.where("v is not null").select("u", "v", *_PASSAGE, "whole")
    return inner.unionByName(found), pairs, local.where("shared is not null").select(F.col("u").alias("node"), "shared", "open")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per passage and document that is not its first place.

    Columns: id, kind ("passage" or "copy"), start_word, end_word, other_id,
    other_start, other_end, matches, similarity.
    """
    kind = docs.schema[id_col].dataType
    numbered = docs.select(F.monotonically_increasing_id().alias("node"), docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("size", F.octet_length("text"))
    volume = Observation()
    rows = stored(numbered.observe(volume, F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), "rows")
    # a hash range for each block's worth of text, so that a range fits a task at any size
    bits = max(5, (int(volume.get["bytes"]) // BLOCK_BYTES).bit_length())
    texts = rows.select(F.col("node").alias("_row"), "text", "size")

    found, pairs, inner = _linked(rows.select("node", "text"), texts, seed_keys, bits)
    spans = found.groupBy("u", "v").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    spans = stored(spans, "spans").hint("shuffle_hash")  # grows with the corpus: never broadcast

    def inside(start: Column, end: Column) -> Column:
        held = F.exists("spans", lambda p: (p["start_word"] <= start) & (end <= p["end_word"]))
        return F.coalesce(held, F.lit(False))

    none = F.array().cast("array<int>")
    first = pairs.join(spans, ["u", "v"], "left").select(
        F.col("u").alias("node"), F.col("seeds.pu").alias("shared"), F.transform(F.filter("seeds", lambda x: ~inside(x["pu"], x["pu"] + M)), lambda x: x["pu"]).alias("open")
    )
    pivots = pairs.select("v", F.explode("seeds.pv").alias("at")).distinct().groupBy(F.col("v").alias("node")).agg(F.collect_list("at").alias("shared"))
    around = inner.unionByName(first).unionByName(pivots.withColumn("open", none)).groupBy("node")
    around = around.agg(F.flatten(F.collect_list("shared")).alias("shared"), F.flatten(F.collect_list("open")).alias("open"))
    around = stored(around.where(F.size("open") > 0), "around")
    with runtime_filter(docs.sparkSession):
        wide = rows.select("node", "text").join(around.hint("shuffle_hash"), "node").select("node", "text", "shared", "open")
        more, _, _ = _linked(wide, texts, window_keys, bits)
    more = more.join(spans, ["u", "v"], "left").where(~inside(F.col("start_word"), F.col("end_word"))).drop("spans")
    found = found.unionByName(more)

    ids = rows.select("node", "id")
    left, right = ids.select(F.col("node").alias("u"), F.col("id").alias("own")), ids.select(F.col("node").alias("v"), F.col("id").alias("other"))
    words = F.greatest(F.col("end_word") - F.col("start_word"), F.col("other_end") - F.col("other_start"))
    out = found.join(left, "u").join(right, "v").select(
        F.col("own").alias(id_col), F.when(F.col("whole"), "copy").otherwise("passage").alias("kind"), "start_word", "end_word",
        F.col("other").alias(f"other_{id_col}"), "other_start", "other_end", "matches", (F.col("matches") / words).alias("similarity"),
    )
    assert out.schema[id_col].dataType == kind
    return out
