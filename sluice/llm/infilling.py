"""Fill-in-the-middle rows by a two-pass streaming matcher of constant memory.

A text is cut into units, the matches of a pattern (single code points unless
another pattern is given), and two ranks drawn from the document's id say after
how many units the prefix and the middle end.  The first pass over the matches
only counts them.  The second advances a lazy iterator of matches to the lower
rank, notes where that match ends, and goes on to the higher one.  One match is
alive at a time and no list of units is ever stored, so a row needs its text,
its output and a few numbers whatever its number of units.

One narrow pass, no shuffle, each row on its own: a hot source or group of
copies changes nothing, and a lost task is run again by itself.  Texts are put
together again from the outputs with column functions, apart from the code
that made them.

Defined results: a null text counts as empty, an empty one has no units and
stays plain; a text that holds a sentinel stays plain; a null id draws as an
empty one; repeated rows each give the same row; very long texts are cut whole,
as batches are cut by bytes and a longer text is a batch of its own; ties (both
ranks equal) give an empty middle; an empty table gives an empty table.  Only
the id and the text are read, so other columns, whatever their names, never
clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import slices

#: Patterns of units: a code point; a word with the spaces before it; a line with its end.
CHARACTER, WORD, LINE = r"(?s:.)", r"\s*\S+", r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of a hundred that are rearranged, and those of a hundred of them in suffix-prefix-middle order.
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = "1"


def counted(matches: Iterator[re.Match]) -> int:
    """How many matches an iterator gives; one is held at a time."""
    last = deque(enumerate(matches, 1), maxlen=1)
    return last[0][0] if last else 0


def ends_at(matches: Iterator[re.Match], ranks: tuple[int, int]) -> tuple[int, int]:
    """Ends of the matches of two ascending ranks from 1 (rank 0: the text's start), advancing no further than the second."""
    low, high = ranks
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def draws(seed: str, key: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def check_sentinels(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand, or texts could not be put together again."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[:i] == b[-i:] for i in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must not be empty, hold one another or overlap")
    if len(set(marks)) < 3:
        raise ValueError("three different sentinels are needed")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CHARACTER, sentinels: tuple[str, str, str] = SENTINELS,
    rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED,
) -> DataFrame:
    """A row per document: id, n (units), form, prefix_chars, middle_chars (code points, null if plain), output.

    ``form`` is ``plain`` (the output is the text), ``psm`` (prefix, suffix,
    middle) or ``spm`` (suffix, prefix, middle).
    """
    check_sentinels(sentinels)
    p, s, m = sentinels
    re.compile(unit)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                n = counted(pattern.finditer(text))
                h1, h2, h3, h4 = draws(seed, batch.column("id")[i].as_py())
                if not text or h3 % 100 >= rearranged or any(mark in text for mark in sentinels):
                    out.append((n, "plain", None, None, text))
                    continue
                ranks = h1 % (n + 1), h2 % (n + 1)
                a, b = ends_at(pattern.finditer(text), (min(ranks), max(ranks)))
                if h4 % 100 < suffix_first:
                    out.append((n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"))
                else:
                    out.append((n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, k()) for c, k in (("n", T.LongType), ("form", T.StringType), ("prefix_chars", T.LongType), ("middle_chars", T.LongType), ("output", T.StringType)))])
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of :func:`transform` was made from."""
    check_sentinels(sentinels)
    p, s, m = sentinels

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, a, -1), b, 1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
