"""Shared folder, Arrow batches and vectorised word hashing for the operators.

Word hashing works on whole Arrow string buffers with numpy, so no Python
object is made per word.  A word's hash is a polynomial over its bytes modulo
2**64, finished with a bijective mixer; two different words collide with
probability about 2**-64 per compared pair, and operators that must be exact
beyond that compare the words themselves afterwards.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a plain ``local`` master may fall back on a temporary folder of this
    machine; on a cluster an unset folder is an error, not a guess.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="sluice-"))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor never recomputes what is above) and
    lets later steps read the rows twice without recomputing them.  The files
    go when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored` that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Share of all rows, one in so many, beyond which a key is joined apart, and the least rows that count as many.
SPREAD_SHARE, SPREAD_LEAST = 1000, 1000


def spread_join(big: DataFrame, small: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """The inner join of ``big`` with ``small``, which has a row per key and in ``size`` at least the key's rows in ``big``.

    The sizes add up to twice the ``total`` at most, so fewer than two thousand
    keys have more than a thousandth of it; theirs are broadcast and their rows
    stay where they are, and the other keys meet in a shuffle.  Both frames are
    read twice: pass stored ones.
    """
    many = small.where(F.col(size) > max(SPREAD_LEAST, total // SPREAD_SHARE))
    hot = big.join(F.broadcast(many), on)
    rest = big.join(F.broadcast(many.select(*on)), on, "left_anti")
    return hot.unionByName(rest.join(small.hint("shuffle_hash"), on))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Join and cut batches so that each holds about ``max_bytes`` of ``column``, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, max_bytes):
        held.append(batch)
        size += int(text_buffer(batch.column(column))[1][-1])
        if size >= max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]
NONSPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE[FOLD]
_STEP = np.uint64(0x9E6C63D0876A9A47)
_CHAIN = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = max(n, 256)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _STEP, np.uint64))])
    return _powers


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of ``inside`` bytes, and each row's first run."""
    m = inside[data]
    before = np.zeros(len(m), bool)
    after = np.zeros(len(m), bool)
    if len(m):
        before[1:] = m[:-1]
        after[:-1] = m[1:]
        before[offsets[:-1][offsets[:-1] < len(m)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word; ``fold`` lower-cases A-Z first."""
    out = np.empty(len(starts), np.uint64)
    table = _FOLDED if fold else _BYTE
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(sums, sums[at] + step, side="right")) - 1, at + 1)
        lens = (ends - starts)[at:to]
        first = sums[at:to] - sums[at]
        pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
        out[at:to] = np.add.reduceat(table[data[pos + np.repeat(starts[at:to], lens)]] * _power(int(lens.max()))[pos], first)
        at = to
    return _mixed(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive words, over row borders too: see :func:`window_ok`."""
    n = max(len(words) - k + 1, 0)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _CHAIN + words[j : n + j]
    return _mixed(acc)


def window_ok(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of :func:`window_hashes` lie in one row."""
    n = max(int(ptr[-1]) - k + 1, 0)
    row_end = np.repeat(ptr[1:], np.diff(ptr))[:n]
    return np.arange(n) + k <= row_end


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def pack(a: np.ndarray) -> bytes:
    """An array as a compressed blob with its length in front."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)
