"""Exact n-gram Jaccard join as a blocked sparse product, and its components.

Documents are rows, distinct word shingles are columns of a 0/1 incidence
matrix; the overlaps of all pairs are its product with its own transpose.  The
product is never formed whole:

* Documents with one shingle set, told by a 128-bit signature, are one class; a
  class has one row, numbered by half of its signature, or by a hash of the whole
  where classes share that half.
* Columns are ordered, shingles that many documents of a partition share last
  (by their summed local counts), the others by hash.  Two sets with Jaccard of
  75 % or more share a column among the first ``n - ceil(0.75 n) + 1`` of
  each, so only these columns are multiplied (any order is exact; this one
  keeps columns short).  Only a bounded list of frequent shingles is broadcast.
* Columns are dealt into blocks by hash.  Each block's partial product counts
  the pairs of its columns up to ``WIDE`` rows; partial counts are summed over
  the blocks, and pairs below the bound that their sizes give are discarded.
* A wider column first gives only pairs with its most central row.  After these are
  checked and joined into components, it gives, in square sub-blocks, the pairs
  whose rows still lie in different components: all that can change the result.
* The remaining pairs' sets meet in groups of a few hundred rows, whose exact
  overlap is counted from the texts.

So groups of copies cost a link per member, not a pair per two members, and
nothing is capped.

Defined results: null and empty texts, and texts without words, have an empty
set, no links and are their own component; fewer words than a shingle make one
shingle of the whole sequence; repeated rows (with one id or several) share a
class; rows with a null id take part, and give a null component only when
no row of theirs has an id; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import NONSPACE, _mixed, drop_stored, slices, spread_join, stored, text_buffer, window_hashes, word_bounds, word_hashes
from sluice.llm.meeting import few_first, meet

SHINGLE = 5
#: Jaccard threshold as a percentage.
PERCENT = 75
#: Rows of a column up to which its pairs are all counted at once.
WIDE = 32
#: Frequent shingles that are put last, at most (8 bytes each are broadcast), and their least summed count.
FREQUENT, FREQUENT_LEAST = 2_000_000, 16
#: Rows side of a square sub-block of a wide column; rows of a verification group.
SQUARE, GROUP = 2000, 300
_LOCAL = 1 << 21
#: Halves of signatures that may stand for several classes.
MOST_SHARED = 100_000


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    data, offsets = text_buffer(col)
    starts, ends, ptr = word_bounds(data, offsets, NONSPACE)
    words = word_hashes(data, starts, ends)
    every = window_hashes(words, k)
    out = []
    for a, b in itertools.pairwise(ptr.tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(_mixed(s).sum(dtype=np.uint64).astype(np.int64)), int(_mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def _local_counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several distinct sets of some 2 million local shingles hold, and how many do."""
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    size = 0

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        more = n > 1
        return pa.RecordBatch.from_arrays([pa.array(h[more].view(np.int64)), pa.array(n[more].astype(np.int64))], names=["h", "n"])

    for batch in slices(batches, "text"):
        for s in shingle_sets(batch.column("text"), k):
            if len(s) and (sig := _signature(s)) not in seen:
                seen.add(sig)
                held.append(s)
                size += len(s)
        if size >= _LOCAL:
            yield out()
            held, seen, size = [], set(), 0
    yield out()


#: Turns the order of unsigned hashes into that of signed ones.
_SIGN = np.uint64(1 << 63)


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _prefixed(batches: Iterator[pa.RecordBatch], text: str, k: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """Set size, signature, share of rare shingles in thousandths, and column prefix (of a task's equal sets the first)."""
    common, weight = frequent.value
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, text):
        sizes, one, two, rare, prefixes, end_weight, end_hash = [], [], [], [], [], [], []
        for s in shingle_sets(batch.column(text), k):
            n = len(s)
            at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
            late = common[at] == s if len(common) else np.zeros(n, bool)
            a, b = _signature(s)
            p = _prefix_length(n, percent)
            first = s[~late][:p]
            if len(first) < p:
                rest = np.flatnonzero(late)
                first = np.concatenate([first, s[rest[np.lexsort((s[rest], weight[at[rest]]))]][: p - len(first)]])
            last = first[-1:]
            where = np.searchsorted(common, last) if len(common) else np.zeros(len(last), np.int64)
            end_weight.append(int(weight[where[0]]) if n and where[0] < len(common) and common[where[0]] == last[0] else 0)
            end_hash.append(int((last ^ _SIGN).view(np.int64)[0]) if n else 0)
            if (a, b) in seen:
                first = first[:0]
            seen.add((a, b))
            rare.append(1000 * int(n - late.sum()) // n if n else 0)
            sizes.append(n)
            one.append(a)
            two.append(b)
            prefixes.append(first.view(np.int64))
        offs = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        cells = [pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(rare, pa.int32()), pa.array(end_weight, pa.int64()), pa.array(end_hash, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(prefixes)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, "_n", "_s1", "_s2", "_rare", "_e1", "_e2", "_prefix"])


def prepare(docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """The stored documents with a row number, set size, set signature and column prefix."""
    spark = docs.sparkSession
    plain = docs.select(F.col(text_col).alias("text"))
    counts = plain.mapInArrow(lambda b: _local_counts(b, k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    frequent = spark.sparkContext.broadcast((h[order], n[order]))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    numbered = docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()).withColumn("_size", F.octet_length(text))
    schema = T.StructType([*numbered.schema, *T._parse_datatype_string("_n long, _s1 long, _s2 long, _rare int, _e1 long, _e2 long, _prefix array<long>")])
    return stored(numbered.mapInArrow(lambda b: _prefixed(b, text, k, percent, frequent), schema), "prefixes")


def _fits(nu: np.ndarray, nv: np.ndarray, ru: np.ndarray, rv: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the places of a shared column leave room for the threshold."""
    low, high = np.minimum(nu, nv), np.maximum(nu, nv)
    most = np.minimum(ru, rv) + 1 + np.minimum(nu - ru - 1, nv - rv - 1)
    return (100 * low >= percent * high) & ((100 + percent) * most >= percent * (nu + nv))


_OUT = [("h", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("nu", pa.int64()), ("nv", pa.int64()), ("c", pa.int64()), ("r", pa.int32()), ("fits", pa.bool_())]
_OUT_SQL = "h long, u long, v long, nu long, nv long, c long, r int, fits boolean"


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols["u"])
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in _OUT], names=[k for k, _ in _OUT])


class _Pairs:
    """Partial counts of pairs, handed on when many have gathered."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> None:
        if len(u):
            swap = u < v
            self.parts.append(np.column_stack([np.where(swap, v, u), np.where(swap, u, v), np.where(swap, nv, nu), np.where(swap, nu, nv)]))
            self.n += len(u)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            every = np.concatenate(self.parts)
            order = np.lexsort((every[:, 1], every[:, 0]))
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(axis=1)]))
            c = np.diff(np.concatenate([first, [len(every)]]))
            u, v, nu, nv = every[first].T
            yield _batch(u=u, v=v, nu=nu, nv=nv, c=c)
            self.parts, self.n = [], 0


def _block_product(batches: Iterator[pa.RecordBatch], percent: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, n, rank, rare) sorted by h, rare and node: pair counts of short columns, members of wide ones.

    A wide column's first row, the one with the least share of rare shingles,
    is its pivot: what a group of altered copies has in common is frequent, so
    that is the row nearest to all of them.
    """
    pairs = _Pairs()
    held: list[np.ndarray] = []
    n_held = 0
    pivot: np.ndarray | None = None
    last_seen: np.ndarray | None = None

    def members(x: np.ndarray) -> pa.RecordBatch:
        p = np.broadcast_to(pivot, x.shape)
        ok = _fits(x[:, 2], p[:, 2], x[:, 3], p[:, 3], percent) & (x[:, 1] != p[:, 1])
        return _batch(h=x[:, 0], u=x[:, 1], v=p[:, 1], nu=x[:, 2], nv=p[:, 2], r=x[:, 3].astype(np.int32), fits=ok)

    def columns(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
        size = np.diff(np.concatenate([first, [len(x)]]))
        for m in np.unique(size[(size > 1) & (size <= wide)]).tolist():
            i, j = np.triu_indices(m, 1)
            of = first[size == m]
            for part in np.array_split(of, max(1, len(of) * len(i) // 2_000_000)):
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                ok = _fits(x[a, 2], x[b, 2], x[a, 3], x[b, 3], percent)
                pairs.add(x[a[ok], 1], x[b[ok], 1], x[a[ok], 2], x[b[ok], 2])
        nonlocal pivot
        for a, m in zip(first[size > wide].tolist(), size[size > wide].tolist(), strict=True):
            pivot = x[a]
            yield members(x[a : a + m])
        pivot = None

    for batch in batches:
        x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        again = np.concatenate([[False], (x[1:, :2] == x[:-1, :2]).all(axis=1)]) if len(x) else np.zeros(0, bool)
        if len(x) and last_seen is not None:
            again[0] = bool((x[0, :2] == last_seen).all())
        if len(x):
            last_seen = x[-1, :2].copy()
        x = x[~again]  # one class from several tasks
        if not len(x):
            continue
        if pivot is not None:  # the wide column that the last batch ended in goes on
            own = int(np.searchsorted(x[:, 0], pivot[0], side="right"))
            if own:
                yield members(x[:own])
            x = x[own:]
            if not len(x):
                continue
            pivot = None
        held.append(x)
        n_held += len(x)
        last = x[-1, 0]
        if held[0][0, 0] == last and n_held > wide:
            pivot = held[0][0].copy()
            yield members(np.concatenate(held))
            held, n_held = [], 0
            continue
        every = np.concatenate(held)
        cut = int(np.searchsorted(every[:, 0], last, side="left"))
        if cut:
            yield from columns(every[:cut])
        rest = every[cut:]
        held, n_held = [rest], len(rest)
        if n_held > wide:
            pivot = rest[0].copy()
            yield members(rest)
            held, n_held = [], 0
        if pairs.n >= 1_000_000:
            yield from pairs.out()
    if held:
        yield from columns(np.concatenate(held))
    yield from pairs.out()


def _square_product(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, i, j, side, node, n, rank, component, wide, end, end) sorted by the first three: pairs across components.

    These pairs share no short column, or they were checked before.  Of two
    sets the one whose prefix ends first has every common prefix column of its
    own in the other's prefix too; so their overlap is at most their wide
    columns and what lies behind that prefix.
    """
    pairs = _Pairs()
    held: list[np.ndarray] = []

    def square(x: np.ndarray) -> None:
        left = x[x[:, 3] == x[:, 1]]
        right = x[x[:, 3] == x[:, 2]]
        for part in np.array_split(left, max(1, len(left) * len(right) // 1_000_000)):
            if len(part) and len(right):
                a, b = np.nonzero((part[:, None, 7] != right[None, :, 7]) & (part[:, None, 4] != right[None, :, 4]))
                x, y = part[a], right[b]
                first = (x[:, 9] < y[:, 9]) | ((x[:, 9] == y[:, 9]) & (x[:, 10] <= y[:, 10]))
                n = np.where(first, x[:, 5], y[:, 5])
                most = np.minimum(x[:, 8], y[:, 8]) + (percent * n + 99) // 100 - 1
                ok = _fits(x[:, 5], y[:, 5], x[:, 6], y[:, 6], percent) & ((100 + percent) * most >= percent * (x[:, 5] + y[:, 5]))
                pairs.add(x[ok, 4], y[ok, 4], x[ok, 5], y[ok, 5])

    for batch in batches:
        x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(11)])
        if not len(x):
            continue
        every = np.concatenate([*held, x])
        first = np.flatnonzero(np.concatenate([[True], (every[1:, :3] != every[:-1, :3]).any(axis=1)])).tolist()
        for a, b in itertools.pairwise(first):
            square(every[a:b])
            if pairs.n >= 1_000_000:
                yield from pairs.out()
        held = [every[first[-1] :]]
    if held:
        square(np.concatenate(held))
    yield from pairs.out()


def _verified(rows: pa.Table, pairs: pa.Table, k: int, percent: int) -> pa.Table:
    links: list[tuple[int, int]] = []
    if rows.num_rows and pairs.num_rows:
        number = {node: i for i, node in enumerate(rows.column("node").to_pylist())}
        sets = shingle_sets(rows.column("text"), k)
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
            a, b = sets[number[u]], sets[number[v]]
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                links.append((u, v))
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the threshold; ``texts`` has _row and text."""
    heads = classes.select("node", "_row")
    return meet(few_first(pairs), texts, lambda a, b: _verified(a, b, k, percent), "u long, v long", GROUP, heads)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node with a link.

    Each round takes the least label among a node's neighbours and then follows
    labels to their own labels; every round is written, so a lost executor
    repeats none.  Minima combine before the shuffle, so a node with very many
    links is no hot spot of the aggregation.
    """
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    total = both.count()
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "v"), ["v"], "n", total).groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", "n", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = hooked.select(F.col("node").alias("p"), F.col("label").alias("q"))
        new = stored(hooked.join(jump, hooked["label"] == jump["p"]).select("node", "n", "old", F.least("label", "q").alias("label")), "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label", "n")
        if not moved:
            return labels.select("node", "label")


def _class_number(classes: DataFrame) -> Column:
    """A number for each class: half of its signature, or where several classes share that, a hash of the whole.

    Among n classes n * n / 2**65 pairs share a half, about three at 10**10, so the list is short.
    """
    several = classes.groupBy("_s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_s1").limit(MOST_SHARED + 1).collect()
    if not several:
        return F.col("_s1")
    if len(several) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} halves of signatures stand for several classes")
    number = F.when(F.array_contains(F.lit([r._s1 for r in several]), F.col("_s1")), F.xxhash64("_s1", "_s2", "_n")).otherwise(F.col("_s1"))
    if classes.groupBy(number.alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two classes share a number")
    return number


def link_classes(rows: DataFrame, text: str, k: int, percent: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """Classes (_s1, _s2, _n, node) of equal sets, and (node, label) of linked classes."""
    classes = rows.where("_n > 0").groupBy("_s1", "_s2", "_n").agg(F.min("_row").alias("_row"), F.first("_e1").alias("_e1"), F.first("_e2").alias("_e2"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes, "signed")
    node = _class_number(classes)
    classes = classes.withColumn("node", node)
    posts = rows.select(node.alias("node"), "_n", "_rare", F.posexplode("_prefix").alias("rank", "h"))
    dealt = posts.select("h", "node", "_n", "rank", "_rare").repartition(F.col("h")).sortWithinPartitions("h", "_rare", "node")
    product = stored(dealt.mapInArrow(lambda b: _block_product(b, percent, wide), _OUT_SQL), "product")

    wide_rows = product.where("h is not null")
    in_wide = wide_rows.groupBy("u").agg(F.count(F.lit(1)).alias("w"))
    info = classes.select("node", F.col("_n").alias("n"), "_e1", "_e2").join(in_wide, classes["node"] == in_wide["u"], "left")
    info = stored(info.select("node", "n", F.coalesce("w", F.lit(0)).alias("w"), "_e1", "_e2"), "info")
    starred = wide_rows.where("fits").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(0).cast("long").alias("c"))
    counted = product.where("h is null").select("u", "v", "c").union(starred).groupBy("u", "v").agg(F.sum("c").alias("c"))
    left = info.select(F.col("node").alias("u"), F.struct("_e1", "_e2").alias("eu"), F.col("n").alias("nu"), F.col("w").alias("wu"))
    right = info.select(F.col("node").alias("v"), F.struct("_e1", "_e2").alias("ev"), F.col("n").alias("nv"), F.col("w").alias("wv"))
    counted = counted.join(left, "u").join(right, "v")
    # a set's columns beyond its prefix, of the set whose prefix ends first
    spare = F.ceil(F.lit(percent) * F.when(F.col("eu") <= F.col("ev"), F.col("nu")).otherwise(F.col("nv")) / 100) - 1
    most = F.col("c") + F.least("wu", "wv") + spare
    first = counted.where((100 + percent) * most >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")
    texts = rows.select("_row", F.col(text).alias("text"), F.col("_size").alias("size"))
    links = verify(first, classes, texts, k, percent)
    labels = components(links)

    tagged = wide_rows.select("h", "u", "nu", "r").join(labels, wide_rows["u"] == labels["node"], "left")
    own = info.select(F.col("node").alias("u"), "w", "_e1", "_e2")
    tagged = tagged.select("h", "u", "nu", "r", F.coalesce("label", "u").alias("label")).join(own, "u")
    mixed = tagged.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    sides = F.greatest(F.lit(1), F.ceil(F.col("size") / SQUARE)).cast("int")
    cells = tagged.join(mixed.select("h", "size"), "h").withColumn("sides", sides).withColumn("own", F.pmod(F.xxhash64("u"), F.col("sides")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cells = cells.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "u", "nu", "r", "label", "w", "_e1", "_e2")
    cells = cells.repartition(F.col("h"), F.col("i"), F.col("j")).sortWithinPartitions("h", "i", "j")
    across = stored(cells.mapInArrow(lambda b: _square_product(b, percent), _OUT_SQL).select("u", "v"), "across")
    if across.limit(1).count():
        links = stored(links.union(verify(across, classes, texts, k, percent)), "links")
        labels = components(links)
    for done in (product, info, across):
        drop_stored(done)
    return classes, labels


def _placed(rows: DataFrame, id_col: str, text: str, k: int = SHINGLE, percent: int = PERCENT, wide: int = WIDE) -> DataFrame:
    classes, labels = link_classes(rows, text, k, percent, wide)
    grouped = stored(classes.join(labels.hint("shuffle_hash"), "node", "left").select("_s1", "_s2", "_n", "size", F.coalesce("label", "node").alias("group")), "grouped")
    slim = rows.select("_row", F.col(id_col).alias("id"), "_n", "_s1", "_s2")
    total = rows.count()
    # rows without a set are linked with nothing and take no part in the joins
    placed = stored(spread_join(slim.where("_n > 0"), grouped, ["_s1", "_s2", "_n"], "size", total).select("_row", "id", "_n", "group"), "placed")
    head = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("_row"))).alias("head")
    first = stored(placed.groupBy("group").agg(F.min("id").alias("least"), head, F.count(F.lit(1)).alias("size")), "first")
    some = spread_join(placed, first, ["group"], "size", total).select("_row", "id", F.col("_n").alias("n_shingles"), F.col("least").alias("component_id"), (F.col("head._row") == F.col("_row")).alias("_keep"))
    return some.union(slim.where("_n = 0").select("_row", "id", F.col("_n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("_keep")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, wide: int = WIDE) -> DataFrame:
    """A row per document: its id, n_shingles and component_id (the smallest id reachable)."""
    rows = prepare(docs.select(id_col, text_col), text_col, k, percent)
    return _placed(rows, "c0", "c1", k, percent, wide).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; same columns.

    Documents without shingles all stay.
    """
    names = docs.columns
    rows = prepare(docs, text_col, SHINGLE, PERCENT)
    gone = _placed(rows, f"c{names.index(id_col)}", f"c{names.index(text_col)}").where("not _keep").select("_row")
    gone = stored(gone, "gone").hint("shuffle_hash")  # grows with the corpus: never broadcast
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
