"""Nearest neighbours by largest inner product, through cross-polytope hashing.

1. Equal vectors become one point with its ``top`` + 1 smallest ids, which are all
   that any result can name: copies score alike and ties go to smaller ids.
2. Vectors are brought to unit length.  Where lengths differ, a point gets one
   more coordinate that fills it up to the longest one's length, so that the
   nearest angle is the largest product; queries have zero there.
3. Each of ``TABLES`` tables turns a vector by pseudo-rotations (three rounds of
   random signs and a fast Hadamard transform) and names the nearest signed
   axis; further rotations, the last over few axes, refine the bucket until it
   holds about ``BUCKET`` points.
4. A query probes a table's buckets in the order of its squared distances to
   their axes.  How many is fitted: the exact neighbours of at most ``SAMPLE``
   queries, found by a scan of all points, must be met by ``AIM`` of their
   buckets; buckets grow where ``MOST_PROBES`` do not reach that.
5. Points and queries meet by cells, runs of neighbouring buckets.  A cell of
   very many points or queries is cut into blocks that meet pair by pair, so a
   hot group costs bounded memory and loses nothing.  The first table gives
   each query a score to beat; the others return only what beats it.
   Candidates are reranked by the exact product of the original vectors.

Every row is indexed; only the number of probes comes from the sample.

Defined results: vectors that are null, empty, zero or hold a null, NaN or
infinite component take no part, nor do rows without an id; a shorter vector
counts as one with zeros at its end; repeated rows count once; an id with
several vectors is listed once, with its best score, and asks with all of
them; a query's own id is never its neighbour; ties go to smaller ids; very
long vectors are taken in smaller batches; an empty table or no query gives an
empty table.  Only the id and the vector are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.llm.common import lists, stored

TOP, TABLES, BUCKET, SEED = 20, 8, 16, 12
#: Sampled queries, share of their neighbours to be met, and probes of a table at most.
SAMPLE, AIM, MOST_PROBES = 256, 0.975, 4096
#: Cells of a table at least and at most, points of a cell on average between them, rows of a block on either side,
#: pairs of a block held at once, and vector bytes of a batch.
LEAST_CELLS, MOST_CELLS, CELL, BLOCK, PAIRS, BATCH_BYTES = 32, 4096, 8192, 32768, 1 << 21, 8 << 20


# ------------------------------------------------------------------------ hashing


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        pair = x.reshape(len(x), -1, 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int, level: int) -> np.ndarray:
    """A pseudo-rotation: three times random signs, then a Hadamard transform."""
    signs = np.random.default_rng([SEED, table, level])
    for _ in range(3):
        x = hadamard(x * signs.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


@dataclass(frozen=True)
class Plan:
    """How vectors are hashed: lengths, axes of each level, cells of a table and probes of a query in each table."""

    dims: int
    longest: float
    even: bool
    points: int
    bucket: int = BUCKET
    probes: int = 1

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dims + (not self.even) - 1).bit_length())

    @property
    def axes(self) -> list[int]:
        left, out = max(2, self.points // self.bucket), []
        while left >= 2:
            out.append(min(self.width, left // 2))
            left //= 2 * out[-1]
        return out

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * d for d in self.axes], dtype=object))

    @property
    def cells(self) -> int:
        return min(self.buckets, MOST_CELLS, max(LEAST_CELLS, self.points // CELL))

    def units(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """Unit vectors of the hashed width."""
        out = np.zeros((len(x), self.width))
        peak = np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
        norm = np.maximum(np.sqrt(((x / peak) ** 2).sum(axis=1, keepdims=True)) * peak, np.finfo(float).tiny)
        if self.even or queries:
            out[:, : self.dims] = x / norm
        else:
            out[:, : self.dims] = x / self.longest
            out[:, self.dims] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def sides(self, unit: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each level, how far a vector goes along its signed axes."""
        for level, d in enumerate(self.axes):
            y = turned(unit, table, level)[:, :d]
            yield np.concatenate([y, -y], axis=1)

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector."""
        out = np.zeros(len(unit), np.int64)
        for side in self.sides(unit, table):
            out = out * side.shape[1] + side.argmax(axis=1)
        return out

    def probed(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The nearest ``probes`` buckets of each vector, nearest first.

        Of two sorted lists of costs the pair (i, j) has (i+1)(j+1) - 1 pairs before it, so few pairs can be among the least.
        """
        key, cost = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for side in self.sides(unit, table):
            gap = (side.max(axis=1, keepdims=True) - side) ** 2
            order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
            gap = np.take_along_axis(gap, order, 1)
            i = np.concatenate([np.full(min(gap.shape[1], probes // (a + 1)), a) for a in range(min(key.shape[1], probes))])
            j = np.concatenate([np.arange(min(gap.shape[1], probes // (a + 1))) for a in range(min(key.shape[1], probes))])
            both = cost[:, i] + gap[:, j]
            pick = np.argsort(both, axis=1, kind="stable")[:, :probes]
            cost = np.take_along_axis(both, pick, 1)
            key = np.take_along_axis(key[:, i] * side.shape[1] + order[:, j], pick, 1)
        return key

    def cell(self, key: np.ndarray) -> np.ndarray:
        """Runs of neighbouring buckets; floating point is exact enough, as points and queries use the same."""
        return np.minimum((key.astype(float) * (self.cells / self.buckets)).astype(np.int32), self.cells - 1)


# ------------------------------------------------------------------------ vectors in batches


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as doubles, short rows filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BATCH_BYTES // (8 * dims))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct rows (id, vec) that take part."""
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids must be whole numbers")
    kind = vectors.schema[vec_col].dataType.elementType
    vec = vectors[vec_col] if isinstance(kind, T.FloatType) else vectors[vec_col].cast("array<double>")
    slim = vectors.select(vectors[id_col].cast("long").alias("id"), vec.alias("vec"))
    inf = F.lit(float("inf"))
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)) & F.exists("vec", lambda x: x != 0)
    return slim.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound).distinct()


# ------------------------------------------------------------------------ candidates


def leading(q: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Each query's ``keep``-th greatest score of its pairs; -inf where it has fewer."""
    order = np.lexsort((-score, q))
    q, score = q[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(q)]]))
    out = np.full(int(q.max()) + 1 if len(q) else 0, -np.inf)
    full = size >= keep
    out[q[start[full]]] = score[start[full] + keep - 1]
    return out


class Found:
    """The best pairs of queries and points seen so far, with a little slack for rounding."""

    def __init__(self, queries: np.ndarray, points: np.ndarray, floor: np.ndarray, keep: int):
        self.queries, self.points, self.keep = queries, points, keep
        norms = [np.sqrt((x * x).sum(axis=1).max()) if len(x) else 0.0 for x in (queries, points)]
        self.slack = 1e-14 * (queries.shape[1] + 8) * norms[0] * norms[1]
        self.floor = floor - self.slack
        self.q, self.p, self.s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        self.held = 0

    def meet(self, q: np.ndarray, p: np.ndarray) -> None:
        """All pairs of these queries and points."""
        step = max(1, PAIRS // max(1, len(p)))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            s = self.queries[some] @ self.points[p].T
            low = self.floor[some]
            if s.shape[1] > self.keep:
                low = np.maximum(low, np.partition(s, -self.keep, axis=1)[:, -self.keep] - self.slack)
            i, j = np.nonzero(s >= low[:, None])
            self.q.append(some[i])
            self.p.append(p[j])
            self.s.append(s[i, j])
            self.held += len(i)
            if self.held > PAIRS:
                self.squeeze()

    def squeeze(self) -> None:
        q, p, s = map(np.concatenate, (self.q, self.p, self.s))
        low = leading(q, s, self.keep) - self.slack
        self.floor[: len(low)] = np.maximum(self.floor[: len(low)], low)
        ok = s >= self.floor[q]
        self.q, self.p, self.s = [q[ok]], [p[ok]], [s[ok]]
        self.held = int(ok.sum())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, points and exact products, added up in the order of the components."""
        self.squeeze()
        q, p = self.q[0], self.p[0]
        exact = np.zeros(len(q))
        for c in range(self.queries.shape[1]):
            exact += self.queries[q, c] * self.points[p, c]
        return q, p, exact


def first_ids(q_id: np.ndarray, q: np.ndarray, ids: pa.ListArray, p: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs spread over the points' ids: each query's first ``top`` others, an id once with its best score."""
    starts, sizes = ids.offsets.to_numpy(), ids.value_lengths().to_numpy(zero_copy_only=False)
    n = sizes[p]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    other = ids.values.to_numpy()[np.repeat(starts[:-1][p], n) + at]
    own, score = q_id[np.repeat(q, n)], np.repeat(score, n)
    ok = own != other
    own, other, score = own[ok], other[ok], score[ok]
    order = np.lexsort((-score, other, own))
    own, other, score = own[order], other[order], score[order]
    once = np.ones(len(own), bool)
    once[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
    own, other, score = own[once], other[once], score[once]
    order = np.lexsort((other, -score, own))
    own, other, score = own[order], other[order], score[order]
    begin = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(own)]])))
    return own[rank < top], other[rank < top], score[rank < top]


def _looked(dims: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block of queries and points of a cell: the queries' best in the buckets that they probe."""

    def look(asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not there.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        key = there.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        bucket, start = np.unique(key[order], return_index=True)
        end = np.append(start[1:], len(key))
        keys = asked.column("keys").combine_chunks()
        probed = keys.flatten().to_numpy()
        q = np.repeat(np.arange(asked.num_rows), keys.value_lengths().to_numpy(zero_copy_only=False))
        spot = np.minimum(np.searchsorted(bucket, probed), len(bucket) - 1)
        real = bucket[spot] == probed
        spot, q = spot[real], q[real]
        by = np.argsort(spot, kind="stable")
        spot, q = spot[by], q[by]
        found = Found(matrix(asked.column("vec"), dims), matrix(there.column("vec"), dims), asked.column("floor").to_numpy(), top + 1)
        cuts = np.flatnonzero(np.diff(spot)) + 1
        for some, same in zip(np.split(q, cuts), np.split(spot, cuts), strict=True):
            if len(same):
                found.meet(some, order[start[same[0]] : end[same[0]]])
        q, p, score = found.pairs()
        ids = there.column("ids").combine_chunks()
        out = first_ids(asked.column("id").to_numpy(), q, ids, p, score, top)
        return pa.table([pa.array(x) for x in out], names=names)

    return look


# ------------------------------------------------------------------------ index and search


@dataclass(frozen=True)
class Index:
    """Points (no, vec, ids) in the shared folder and how they are hashed."""

    points: DataFrame
    plan: Plan
    top: int


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> Index:
    """All vectors that take part, copies as one point."""
    rows = valid(vectors, id_col, vec_col)
    # the first ids of a vector are taken before rows are shuffled, so very many copies are no hot key
    near = rows.withColumn("_no", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_no") <= top + 1)
    points = near.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = stored(points.select(F.monotonically_increasing_id().alias("no"), "vec", "ids"), "points")
    peak = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("_peak"), 2))) * F.col("_peak")
    got = points.withColumn("_peak", peak).agg(F.max(F.size("vec")), F.max(norm), F.min(norm), F.count(F.lit(1))).first()
    dims, longest, shortest, n = got[0] or 1, got[1] or 1.0, got[2] or 1.0, got[3]
    return Index(points, Plan(dims, longest, longest - shortest <= 1e-6 * longest, n), top)


def _nearest_of(sample: pa.Table, plan: Plan, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A scan that keeps each sampled query's best points of a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = matrix(sample.column("vec"), plan.dims), sample.column("id").to_numpy()
        q, vec, score = np.zeros(0, np.int64), np.zeros((0, plan.dims)), np.zeros(0)
        for batch in _parts(batches, plan.dims):
            points = matrix(batch.column("vec"), plan.dims)
            ids = batch.column("ids")
            alone = np.where(ids.value_lengths().to_numpy(zero_copy_only=False) == 1, ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]], -1)
            s = queries @ points.T
            s[own[:, None] == alone[None, :]] = -np.inf
            keep = min(top, s.shape[1])
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            q = np.concatenate([q, np.repeat(np.arange(len(queries)), keep)])
            vec = np.concatenate([vec, points[best.ravel()]])
            score = np.concatenate([score, np.take_along_axis(s, best, 1).ravel()])
            ok = (score > -np.inf) & (score >= leading(q, score, top)[q])
            q, vec, score = q[ok], vec[ok], score[ok]
        yield pa.RecordBatch.from_arrays([pa.array(q), lists(vec.ravel(), np.full(len(q), plan.dims), pa.float64()), pa.array(score)], names=["q", "vec", "score"])

    return scan


def fitted(index: Index, queries: DataFrame) -> Plan:
    """The plan with so many probes that the sampled queries meet ``AIM`` of their exact neighbours."""
    plan = index.plan
    drawn = queries.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).toArrow()
    if not drawn.num_rows or not plan.points:
        return plan
    near = index.points.select("vec", "ids").mapInArrow(_nearest_of(drawn, plan, index.top), "q long, vec array<double>, score double")
    near = near.withColumn("_no", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_no") <= index.top)
    near = near.select("q", "vec").toArrow()  # SAMPLE times top rows at most
    if not near.num_rows:
        return plan
    q, asked, there = near.column("q").to_numpy(), matrix(drawn.column("vec"), plan.dims), matrix(near.column("vec"), plan.dims)
    while True:
        most = min(plan.buckets, MOST_PROBES)
        rank = np.full(len(q), np.iinfo(np.int64).max)
        for table in range(TABLES):
            own = plan.probed(plan.units(asked, True), table, most)
            key = plan.keys(plan.units(there, False), table)
            for i in range(len(asked)):
                at = np.flatnonzero(q == i)
                by = np.argsort(own[i], kind="stable")
                spot = by[np.minimum(np.searchsorted(own[i], key[at], sorter=by), most - 1)]
                rank[at] = np.where(own[i][spot] == key[at], np.minimum(rank[at], spot), rank[at])
        needed = int(np.sort(rank)[max(0, int(np.ceil(AIM * len(rank))) - 1)]) + 1
        if needed <= most:
            return replace(plan, probes=needed)
        plan = replace(plan, bucket=plan.bucket * 4)


def _hashed(plan: Plan, tables: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Points by table: bucket and cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, plan.dims):
            unit = plan.units(matrix(batch.column("vec"), plan.dims), False)
            for t in tables:
                key = plan.keys(unit, t)
                extra = [pa.array(np.full(len(key), t, np.int32)), pa.array(plan.cell(key)), pa.array(key)]
                yield pa.RecordBatch.from_arrays([*extra, *batch.columns], names=["t", "cell", "key", *batch.schema.names])

    return rows


def _probing(plan: Plan, tables: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries by table and cell, with the buckets that they probe there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, max(plan.dims, 8 * plan.probes)):
            unit = plan.units(matrix(batch.column("vec"), plan.dims), True)
            for t in tables:
                keys = plan.probed(unit, t, plan.probes)
                q = np.repeat(np.arange(len(keys)), keys.shape[1])
                key = keys.ravel()
                cell = plan.cell(key)
                order = np.lexsort((key, cell, q))
                q, key, cell = q[order], key[order], cell[order]
                start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (cell[1:] != cell[:-1])]))
                size = np.diff(np.append(start, len(q)))
                picked = batch.take(pa.array(q[start]))
                extra = [pa.array(np.full(len(start), t, np.int32)), pa.array(cell[start]), lists(key, size, pa.int64())]
                yield pa.RecordBatch.from_arrays([*extra, *picked.columns], names=["t", "cell", "keys", *batch.schema.names])

    return rows


def _visited(index: Index, plan: Plan, queries: DataFrame, tables: range) -> DataFrame:
    """Rows (query_id, vec_id, score) from some tables; ``queries`` have id, vec and floor."""
    kind = index.points.schema["vec"].dataType.simpleString()
    points = index.points.mapInArrow(_hashed(plan, tables), f"t int, cell int, key long, no long, vec {kind}, ids array<long>")
    asked = queries.select("id", "vec", "floor").mapInArrow(_probing(plan, tables), f"t int, cell int, keys array<long>, id long, vec {kind}, floor double")
    ask = asked.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("asked"))
    cells = points.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("points")).join(ask, ["t", "cell"])

    def blocks(name: str) -> Column:
        return F.ceil(F.col(name) / F.lit(BLOCK)).cast("int").alias(name)

    # at most TABLES * MOST_CELLS rows
    cells = F.broadcast(stored(cells.select("t", "cell", blocks("points"), blocks("asked")), "cells"))
    left = asked.join(cells, ["t", "cell"]).withColumn("a", F.pmod(F.xxhash64("id", "vec"), F.col("asked"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    right = points.join(cells, ["t", "cell"]).withColumn("p", F.pmod(F.xxhash64("no"), F.col("points"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    block = [F.col("t"), F.col("cell"), F.col("p").cast("int"), F.col("a").cast("int")]
    left = left.select("t", "cell", block[2].alias("p"), block[3].alias("a"), "id", "vec", "floor", "keys").groupBy("t", "cell", "p", "a")
    right = right.select("t", "cell", block[2].alias("p"), block[3].alias("a"), "key", "vec", "ids").groupBy("t", "cell", "p", "a")
    return left.cogroup(right).applyInArrow(_looked(plan.dims, index.top), "query_id long, vec_id long, score double")


def _ranked(pairs: DataFrame, top: int) -> DataFrame:
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(index: Index, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The nearest found of every row of ``vectors``: query_id, rank, vec_id, score."""
    kind = index.points.schema["vec"].dataType
    # what a query has beyond the longest point meets zeros only
    wanted = valid(vectors, id_col, vec_col).select("id", F.slice("vec", 1, index.plan.dims).cast(kind).alias("vec"))
    queries = stored(wanted, "queries")
    plan = fitted(index, queries)
    first = stored(_ranked(_visited(index, plan, queries.withColumn("floor", F.lit(float("-inf"))), range(1)), index.top), "first")
    beat = first.where(F.col("rank") == index.top).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
    floored = queries.join(beat, "id", "left").withColumn("floor", F.coalesce("beat", F.lit(float("-inf"))))
    more = _visited(index, plan, stored(floored.select("id", "vec", "floor"), "floored"), range(1, TABLES))
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(more), index.top)
