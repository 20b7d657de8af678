"""Line-first quality rules.

Every line is judged on its own: punctuation, symbol, shouting, navigation and
boilerplate rules, and repetition of an earlier line.  Failing lines go; a
document that loses too much of its text with them, or that fails the plain
word-count and repetition rule, is rejected.

One pass over the texts, no shuffle: each Arrow batch is cut into slices of a
few megabytes, counts over words are made with numpy over the slice.

Defined results: a null text has no words, so it is rejected with all counts
zero; an empty text likewise; repeated rows and ties are judged row by row; an
empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.common import NONSPACE, row_sums, slices, text_buffer, window_hashes, window_ok, word_bounds, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Share of a document's word characters that must stay.
MIN_KEPT = 0.6
#: Phrases of page furniture; a short line holding one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookies to", "enable javascript", "follow us on",
    "javascript is disabled", "lorem ipsum", "privacy policy", "sign up for", "skip to content",
    "subscribe to our", "terms of service", "terms of use",
)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_TERMINAL = tuple(b".!?:;,\"')]}") + (0xA6, 0x9D, 0x99, 0xBB, 0x82, 0x81)
_LETTER = re.compile(rb"[A-Za-z]")
_UPPER = re.compile(rb"[A-Z]")
_MARKED = re.compile(rb"[#*$%&<>]")


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails, or None.

    A share is taken over the line's words, so a few symbols, capitals or bars
    inside prose never remove it.
    """
    n = len(words)
    bars = line.count(b"|")
    if bars >= 3 and bars * 4 >= n - bars:
        return "navigation"
    if n >= 4 and sum(1 for w in words if _MARKED.search(w)) * 10 >= 4 * n:
        return "symbols"
    if n >= 4 and line.count(b"!!") * 10 >= 4 * n:
        return "shouting"
    if n >= 8 and line.isupper() and len(_UPPER.findall(line)) * 10 >= 9 * max(len(_LETTER.findall(line)), 1):
        return "shouting"
    if n <= 40 and _FURNITURE.search(line.decode("utf-8", "replace").lower()):
        return "boilerplate"
    if n <= 3 and words[-1][-1] not in _TERMINAL:
        return "punctuation"
    return None


def judged_lines(text: bytes) -> tuple[list[bytes], int, int, int]:
    """Lines that stay, repeated lines, removed lines, and word characters of what stays."""
    seen: set[bytes] = set()
    stay, dup, gone, chars = [], 0, 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            stay.append(line)
            continue
        if line in seen:
            dup += 1
            gone += 1
            continue
        seen.add(line)
        if line_fault(line, words):
            gone += 1
        else:
            stay.append(line)
            chars += sum(len(w.decode("utf-8", "replace")) for w in words) if not line.isascii() else sum(map(len, words))
    return stay, dup, gone, chars


def repeated_words(data: np.ndarray, offsets: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and how many of them lie in an ``n``-word window that the row holds twice or more."""
    starts, ends, ptr = word_bounds(data, offsets, NONSPACE)
    words = word_hashes(data, starts, ends, fold=False)
    hashes, ok = window_hashes(words, n), window_ok(ptr, n)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[: len(hashes)].astype(np.uint64)
    hashes = hashes ^ (row * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(hashes[ok])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(words), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
        found = np.flatnonzero((twice[at] == hashes) & ok)
        for j in range(n):
            covered[found + j] = True
    return np.diff(ptr), row_sums(covered, ptr)


_ADDED = (
    ("n_words", pa.int64(), T.LongType()), ("word_chars", pa.int64(), T.LongType()), ("n_symbols", pa.int64(), T.LongType()),
    ("n_dup_lines", pa.int64(), T.LongType()), ("n_repeat_words", pa.int64(), T.LongType()), ("n_removed_lines", pa.int64(), T.LongType()),
    ("kept_chars", pa.int64(), T.LongType()), ("base_failed", pa.bool_(), T.BooleanType()), ("kept", pa.bool_(), T.BooleanType()),
    ("cleaned", pa.large_string(), T.StringType()),
)


def _judge(batches: Iterator[pa.RecordBatch], text_col: str, keep: list[str], wanted: list[str], min_words: int, min_kept: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        col = batch.column(text_col)
        data, offsets = text_buffer(col)
        n_words, n_repeat = repeated_words(data, offsets)
        raw = data.tobytes()
        rows: dict[str, list] = {name: [] for name, _, _ in _ADDED}
        for i, n in enumerate(n_words.tolist()):
            text = raw[offsets[i] : offsets[i + 1]]
            flat = text.translate(None, SPACES)
            chars = len(flat) if flat.isascii() else len(flat.decode("utf-8", "replace"))
            stay, dup, gone, kept_chars = judged_lines(text)
            failed = n < min_words or 100 * int(n_repeat[i]) > 50 * n
            rows["n_words"].append(n)
            rows["word_chars"].append(chars)
            rows["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
            rows["n_dup_lines"].append(dup)
            rows["n_repeat_words"].append(int(n_repeat[i]))
            rows["n_removed_lines"].append(gone)
            rows["kept_chars"].append(kept_chars)
            rows["base_failed"].append(failed)
            rows["kept"].append(not failed and kept_chars >= min_kept * chars)
            if "cleaned" in wanted:
                rows["cleaned"].append((text if not gone else b"\n".join(stay)).decode("utf-8", "replace"))
        out = [batch.column(c) for c in keep] + [pa.array(rows[n], k) for n, k, _ in _ADDED if n in wanted]
        yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])


def judge(docs: DataFrame, keep: list[str], wanted: list[str] | None = None, text_col: str = "text", min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """``keep`` columns of every row with the counts, verdicts and cleaned text named in ``wanted``.

    ``wanted`` is any of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_lines, kept_chars, base_failed, kept, cleaned
    (all by default).  A name in ``keep`` that clashes with one of these stays
    beside it: rename before if that is not wanted.
    """
    wanted = [n for n, _, _ in _ADDED if wanted is None or n in wanted]
    cols = [docs[c] for c in keep if c != text_col] + [docs[text_col]]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, _, k in _ADDED if n in wanted])
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return docs.select(*cols).mapInArrow(lambda b: _judge(b, text_col, keep, wanted, min_words, min_kept), inner).toDF(*schema.names)


def filter_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that pass, their text without the failing lines; same columns.

    ``length_col`` is brought up to date where the text changed.
    """
    from pyspark.sql import functions as F

    names = docs.columns
    marked = judge(docs.toDF(*[f"d_{c}" for c in names]), [f"d_{c}" for c in names], ["n_removed_lines", "kept", "cleaned"], f"d_{text_col}")
    marked = marked.where("kept")
    changed = F.col("n_removed_lines") > 0
    out = []
    for c in names:
        if c == text_col:
            out.append(F.when(changed, F.col("cleaned")).otherwise(F.col(f"d_{c}")).alias(c))
        elif c == length_col:
            out.append(F.when(changed, F.char_length("cleaned").cast(docs.schema[c].dataType)).otherwise(F.col(f"d_{c}")).alias(c))
        else:
            out.append(F.col(f"d_{c}").alias(c))
    return marked.select(*out)
