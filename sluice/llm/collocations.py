"""Phrases whose words stand together more often than their parts suggest.

1. Every piece of text gives its 1- to ``max_n``-grams as DataFrame rows
   (lang, words, phrase, n), equal ones of a batch already added up, and Spark
   adds them by language and phrase.  A phrase of ``least`` occurrences holds
   only words and neighbouring pairs of as many, so a first pass counts words
   and pairs by 64-bit hashes, and n-grams with a rarer word or pair are not
   exploded.  The hashes only ever let too much through; counts are of texts.
2. A candidate is joined to the counts of its first k words and of the rest for
   each k, and its lowest-scoring cut counts.  Scores are whole numbers in
   Decimal(38): 1000 * a * n may pass 64 bits.
3. An anti-join drops phrases that a one-word extension holds as often.  Longer
   ones need no look: a phrase inside one of as many occurrences is inside the
   extensions between them, which have no fewer.
4. Ranks by window, first within slices of each language, then over the slices'
   first rows, so no task ranks a whole language.

The filter of frequent words and pairs is a bit field of at most ``MOST_BITS``
bits (32 MB), broadcast; where a corpus has more of them than it can tell
apart it lets more n-grams through, and results stay the same.  A language
with a third of all rows is many keys, and a very common phrase is one row a
batch, then one a task, before it is shuffled.

Defined results: a null language is ``und``; a null or empty text has no
words; repeated rows count each; ties are ranked by count and then by the
phrase's bytes; very long texts are read whole, a batch of their own; an empty
table gives an empty table.  Only language and text are read, so other
columns, whatever their names, never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import FOLD, byte_class, gathered, stored, text_buffer, window_hashes, word_bounds, word_hashes

#: Bytes that end a piece, and bytes between words of a piece.
ENDS = byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
BLANKS = byte_class((0x20, 0x20), (0x09, 0x09))
MAX_N, LEAST, TOP = 5, 100, 2000
#: Text bytes of a batch, slices of a language for ranking, and bits of the filter at most.
BATCH_BYTES, SLICES, MOST_BITS = 1 << 20, 64, 1 << 28
#: Languages whose totals are broadcast.
FEW_LANGS = 10_000
NO_LANG = "und"


class _Words:
    """Words of a batch in reading order: folded bytes, bounds, hash, piece and language."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = text_buffer(batch.column("text"))
        self.bytes = FOLD[raw]
        self.starts, self.ends, ptr = word_bounds(self.bytes, offsets, ~(ENDS | BLANKS))
        self.hash = word_hashes(self.bytes, self.starts, self.ends, fold=False, step=1 << 18)
        row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        self.piece = np.cumsum(ENDS[self.bytes], dtype=np.int64)[self.starts] + row
        langs = pc.dictionary_encode(pc.fill_null(batch.column("lang"), NO_LANG))
        self.langs = langs.dictionary
        self.lang = np.asarray(langs.indices.to_numpy(zero_copy_only=False), np.int64)[row]
        salts = [int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.salt = np.asarray(salts, np.uint64)[self.lang]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the n-grams within pieces, and their hashes by language."""
        count = max(len(self.hash) - n + 1, 0)
        at = np.flatnonzero(self.piece[:count] == self.piece[n - 1 : n - 1 + count])
        return at, window_hashes(self.hash, n)[at] ^ self.salt[at] * np.uint64(2 * n + 1)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each place, joined by single spaces."""
        words = (at[:, None] + np.arange(n)).ravel()
        lens = (self.ends - self.starts)[words]
        first = np.concatenate([[0], np.cumsum(lens + 1)])
        pos = np.arange(int(first[-1])) - np.repeat(first[:-1], lens + 1)
        blank = pos == np.repeat(lens, lens + 1)
        out = self.bytes[np.minimum(np.repeat(self.starts[words], lens + 1) + pos, len(self.bytes) - 1)]
        out[blank] = 0x20
        last = np.zeros(len(out), bool)
        last[first[n::n] - 1] = True
        ends = np.concatenate([[0], first[n::n] - np.arange(1, len(at) + 1)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[~last].tobytes())).cast(pa.string())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in gathered(batches, "text", BATCH_BYTES):
        yield _Words(batch)


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and neighbouring pairs with their occurrences in the batch."""
    for words in _batches(batches):
        keys = np.concatenate([words.grams(n)[1] for n in (1, 2)])
        key, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def _gram_rows(field: bytes, bits: int, max_n: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.frombuffer(field, np.uint64)

        def frequent(keys: np.ndarray) -> np.ndarray:
            spot = keys & np.uint64(bits - 1)
            return (told[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)

        for words in _batches(batches):
            out: list[list] = [[], [], [], []]

            def give(lang: pa.Array, n: int, phrase: pa.Array, count: np.ndarray, out: list = out) -> None:
                for kept, x in zip(out, (lang, pa.array(np.full(len(count), n, np.int32)), phrase, pa.array(count, pa.int64())), strict=True):
                    kept.append(x)

            # all words of a language, as n = 0
            total = np.bincount(words.lang, minlength=len(words.langs))
            give(words.langs, 0, pa.array([""] * len(words.langs)), total)
            held = np.zeros(len(words.hash), bool)  # the n-gram from here has no rarer word or pair
            for n in range(1, max_n + 1):
                at, keys = words.grams(n)
                if n < 3:
                    ok = frequent(keys)
                    if n == 2:
                        pair = np.zeros(len(words.hash), bool)
                        ok &= held[at] & held[at + 1]
                        pair[at[ok]] = True
                        held = pair
                    else:
                        held[at[ok]] = True
                else:
                    ok = np.logical_and.reduce([held[at + j] for j in range(n - 1)])
                if not ok.any():
                    continue
                _, first, count = np.unique(keys[ok], return_index=True, return_counts=True)
                place = at[ok][first]
                give(words.langs.take(pa.array(words.lang[place])), n, words.phrases(place, n), count)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([y.cast(pa.string()) if pa.types.is_large_string(y.type) else y for y in x]) for x in out], names=["lang", "words", "phrase", "n"])

    return rows


def _bit_field(keys: DataFrame) -> tuple[bytes, int]:
    """A bit for each key's low bits, in a field of at least 16 bits a key up to ``MOST_BITS``."""
    count = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * count - 1).bit_length() if count else 0))
    spot = F.col("key").bitwiseAND(bits - 1)
    # a row for each 64 bits: the field is bounded, so is what comes to the driver
    rows = keys.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, int(key & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    field = np.zeros(bits // 64, np.int64)
    got = rows.toArrow()
    field[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return field.tobytes(), bits


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """Rows (lang, words, phrase, n) of all phrases of ``least`` occurrences; words = 0 has all words of a language."""
    slim = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text_col].alias("text"))
    hashed = slim.mapInArrow(_hash_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    field, bits = _bit_field(stored(hashed.where(F.col("n") >= least).select("key"), "frequent"))
    rows = slim.mapInArrow(_gram_rows(field, bits, max_n), "lang string, words int, phrase string, n long")
    counts = rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Candidates with the parts and the score of their lowest-scoring cut."""
    totals = stored(counts.where("words = 0").select("lang", F.col("n").alias("all")), "totals")
    totals = F.broadcast(totals) if totals.count() <= FEW_LANGS else totals
    cands = counts.where((F.col("words") > 1) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    parts = counts.where("words > 0").select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])

    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    above = whole("a") * F.lit(1000).cast("decimal(4,0)") * whole("all")
    score = F.call_function("div", above, whole("l") * whole("r"))
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "words", "phrase", "a", F.col("all").alias("n")).agg(best).select("lang", "words", "phrase", "a", "best.l", "best.r", "n", "best.score")


def unabsorbed(cands: DataFrame, share: int = 100) -> DataFrame:
    """Candidates that no one-word extension holds ``share`` of a hundred times as often."""
    parts = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = cands.where("words > 2").select(F.col("lang").alias("in_lang"), F.explode(parts).alias("inner"), F.col("a").alias("longer"))
    held = longer.groupBy("in_lang", "inner").agg(F.max("longer").alias("longer"))
    return cands.join(held, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & (F.col("longer") * 100 >= F.col("a") * share), "left_anti")


def ranked(cands: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = cands.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = sliced.withColumn("_no", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_no") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    if least < 1 or max_n < 2:
        raise ValueError("phrases have two words or more and occur at least once")
    cands = stored(scored(phrase_counts(docs, text_col, lang_col, max_n, least), least), "scored")
    return ranked(unabsorbed(cands), top)
