"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  With a byte-level vocabulary the tokens'
bytes add up to the text's, so cumulated token lengths are exact byte spans.
The spans of tokens and of sections are both ascending: their interval join is
a binary search of section borders among token starts.  A token that crosses a
border is allocated by an explicit rule:

* ``first``: to the section of its first byte;
* ``last``: to the section of its last byte;
* ``most``: to the section with most of its bytes, the earlier one in a tie.

So the sections' counts always add up to the document's tokens.  Sections of a
text are its lines (a line break belongs to the line it ends) or, in
``count_fields``, columns that are joined by a separator and encoded together.

One pass, no shuffle.  Defined results: a null or empty text has no tokens and
one section of none; special-token strings in a text are ordinary text;
repeated rows each get a row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lists, slices

RANKS = "byte_bpe_50k.tiktoken"
RULE = "most"
_encodings: dict[str, tuple] = {}


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str):
    """The encoder of a rank file, and the byte length of each id."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, no in ranks.items():
            size[no] = len(word)
        _encodings[path] = (tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
    return _encodings[path]


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and tokens that cross a border.

    ``ends``: each token's end; ``borders``: each section's end, ascending,
    the last one the text's.  Empty sections get no tokens.
    """
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    first = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, ends, side="left")
    owner = first.copy() if rule == "first" else last.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "most":
        owner = first.copy()
        for t in crossing.tolist():
            edge = np.concatenate([[starts[t]], borders[first[t] : last[t]], [ends[t]]])
            owner[t] = first[t] + int(np.argmax(np.diff(edge)))
    elif rule not in ("first", "last"):
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=len(borders)), len(crossing)


def _rows(parts: Iterator[tuple[object, list[str]]], path: str, rule: str, kind: pa.DataType) -> pa.RecordBatch:
    encoder, size = encoding(path)
    ids, total, crossing, n_sections, counts = [], [], [], [], []
    for doc, sections in parts:
        text = "".join(sections)
        ends = np.cumsum(size[encoder.encode_to_numpy(text, disallowed_special=())]) if text else np.zeros(0, np.int64)
        borders = np.cumsum([len(s.encode()) for s in sections])
        own, crossed = attribute(ends, borders, rule)
        ids.append(doc)
        total.append(len(ends))
        crossing.append(crossed)
        n_sections.append(len(sections))
        counts.append(own)
    flat = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(total, pa.int64()), pa.array(n_sections, pa.int64()), pa.array(crossing, pa.int64()), lists(flat, np.asarray(n_sections, np.int64), pa.int64())],
        names=["id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
    )


_SCHEMA = "n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"
_STEP = 500


def count_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = RULE, ranks: str | None = None) -> DataFrame:
    """A row per document: id, n_tokens, n_sections, n_crossing, section_tokens (by line)."""
    path = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):  # by bytes, then by rows
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                texts = ((t or "").split("\n") for t in part.column("text").to_pylist())
                lines = ([*(x + "\n" for x in t[:-1]), t[-1]] for t in texts)
                yield _rows(zip(part.column("id").to_pylist(), lines, strict=True), path, rule, part.schema.field("id").type)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {_SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def count_fields(rows: DataFrame, id_col: str, fields: list[str], separator: str = "\n", rule: str = RULE, ranks: str | None = None) -> DataFrame:
    """The same with ``fields``, joined by ``separator``, as the sections; a null field is an empty section.

    A separator belongs to the field before it.
    """
    path = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                cells = ([*(x + separator for x in c[:-1]), c[-1]] for c in part.column("cells").to_pylist())
                yield _rows(zip(part.column("id").to_pylist(), cells, strict=True), path, rule, part.schema.field("id").type)

    kind = rows.schema[id_col].dataType.simpleString()
    cells = F.array(*[F.coalesce(rows[c].cast("string"), F.lit("")) for c in fields])
    out = rows.select(rows[id_col].alias("id"), cells.alias("cells")).mapInArrow(run, f"id {kind}, {_SCHEMA}")
    return out.withColumnRenamed("id", id_col)
