"""License scan by diagonal voting.

Every document's rolling word 2-grams and 4-grams are hashed; those that stand
in some template (2-grams for short phrases, 4-grams for longer texts) are
joined to their positions there.  A match votes for the diagonal "document
position minus template position"; votes are gathered by diagonal, diagonals of
a long template that are close and follow one another are merged (words were
inserted or lost) whatever other diagonals stand between them, and a span is
accepted when the matches cover enough different words of the template.  The
join is on the gram's words, not their hash, so every vote is verified, and a
phrase place needs all its grams on one diagonal: the phrase word for word.

Hashing is vectorised over Arrow buffers.  Only the template table is broadcast,
whose size is checked; a gram that no template holds never becomes a row.

Defined results: a null or empty text has no words and no labels, score 0;
repeated rows and rows with a null id each get a row of their own; ties need no
rule (labels are sets); an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import ALNUM, slices, text_buffer, window_hashes, window_ok, word_bounds, word_hashes
from sluice.llm.licenses import PHRASES, TEXTS

SHORT, LONG = 2, 4
#: Share of a long template's words that the matches of a merged span must cover.
COVER = 0.6
#: Diagonals at most this far apart, and at most this many words after one another, merge.
BAND, REACH = 20, 40
#: Rows of the template table up to which it is broadcast.
MOST_GRAMS = 100_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_rows(phrases=PHRASES, texts=TEXTS) -> list[tuple[int, str, int, int, str, int, int]]:
    """(k, gram, tpos, tpl, label, grams, words): a row per gram of every template."""
    rows = []
    for tpl, (label, text, k) in enumerate([*((a, b, SHORT) for a, b in phrases), *((a, b, LONG) for a, b in texts)]):
        words = _WORD.findall(text.lower())
        if len(words) < k:
            raise ValueError(f"template {label} has fewer than {k} words")
        grams = len(words) - k + 1
        rows += [(k, " ".join(words[i : i + k]), i, tpl, label, grams, len(words)) for i in range(grams)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} template grams; {MOST_GRAMS} may be broadcast")
    return rows


def _gram_hashes(texts: list[str], k: int) -> np.ndarray:
    """The sorted hashes of texts of ``k`` words."""
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    starts, ends, ptr = word_bounds(data, offsets, ALNUM)
    return np.unique(window_hashes(word_hashes(data, starts, ends), k)[ptr[:-1]])


def _hits(batches: Iterator[pa.RecordBatch], known: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per document its words' number and the grams whose hash some template has."""
    for batch in slices(batches, "text"):
        data, offsets = text_buffer(batch.column("text"))
        starts, ends, ptr = word_bounds(data, offsets, ALNUM)
        words = word_hashes(data, starts, ends)
        raw = data.tobytes()
        every = []
        for k, hashes in known.items():
            own = window_hashes(words, k)
            near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1) if len(hashes) else np.zeros(len(own), np.int64)
            at = np.flatnonzero((hashes[near] == own) & window_ok(ptr, k)) if len(hashes) else np.zeros(0, np.int64)
            grams = [b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + k)).lower().decode() for i in at.tolist()]
            every.append((at, np.full(len(at), k), grams))
        at, size, grams = np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every]), [g for e in every for g in e[2]]
        row = np.searchsorted(ptr, at, side="right") - 1
        order = np.argsort(row, kind="stable")
        hits = pa.StructArray.from_arrays(
            [pa.array(size[order], pa.int32()), pa.array((at - ptr[row])[order], pa.int32()), pa.array([grams[i] for i in order.tolist()], pa.string())], names=["k", "pos", "gram"]
        )
        edges = pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.diff(ptr), pa.int32()), pa.ListArray.from_arrays(edges, hits)], names=["row", "id", "n_words", "hits"])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """Accepted spans (row, id, n_words, tpl, label, base, start, end, score), and one row with null tpl per document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    table = template_rows(phrases, texts)
    known = {k: _gram_hashes([r[1] for r in table if r[0] == k], k) for k in (SHORT, LONG)}
    kind = rows.schema["id"].dataType.simpleString()
    hashed = rows.mapInArrow(lambda b: _hits(b, known), f"row long, id {kind}, n_words int, hits array<struct<k: int, pos: int, gram: string>>")
    marker = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("pos"), F.lit("").alias("gram")))
    every = hashed.select("row", "id", "n_words", F.inline(F.concat(marker, "hits")))
    tpl = F.broadcast(docs.sparkSession.createDataFrame(table, "k int, gram string, tpos int, tpl int, label string, grams int, words int"))
    met = every.join(tpl, ["k", "gram"], "left").where("tpl is not null or k = 0")
    votes = met.groupBy("row", "id", "n_words", "tpl", "label", "k", "grams", "words", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("tpl").alias("votes"), F.collect_set("tpos").alias("places"), F.collect_set("pos").alias("own"), F.min("pos").alias("start"), (F.max("pos") + F.max("k")).alias("end")
    )
    short = F.col("k") == SHORT
    votes = votes.where(F.col("tpl").isNull() | ~short | (F.col("votes") == F.col("grams")))
    alone = short | F.col("tpl").isNull()

    def parted(rows: DataFrame, within: list[str], order: list[str], cut, name: str) -> DataFrame:
        w = Window.partitionBy("row", "tpl", *within).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        marked = rows.withColumn("cut", F.coalesce(alone | cut(w, before), F.lit(True)).cast("int"))
        return marked.withColumn(name, F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def far(w, before) -> Column:
        return F.col("diagonal") - F.lag("diagonal").over(w) > BAND

    # near diagonals first, so that one from elsewhere in the template does not stand between them; rows that
    # are out of reach may have brought others together, so what is left is parted by diagonal again
    bands = parted(votes, [], ["diagonal", "start"], far, "band")
    runs = parted(bands, ["band"], ["start", "diagonal"], lambda w, before: F.col("start") > F.max("end").over(before) + REACH, "run")
    chained = parted(runs, ["band", "run"], ["diagonal", "start"], far, "chain")
    merged = chained.groupBy("row", "id", "n_words", "tpl", "label", "k", "words", "band", "run", "chain").agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("places", "own")), F.min("start").alias("start"), F.max("end").alias("end")
    )

    def covered(places: str) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = F.col("k")
        return F.aggregate(places, zero, lambda acc, p: F.struct((acc["n"] + p + step - F.greatest(acc["end"], p)).alias("n"), (p + step).alias("end")))["n"]

    # words of the template and of the document under at least one match, each counted once
    score = F.least(covered("places"), covered("own")) / F.col("words")
    merged = merged.withColumn("score", F.least(F.lit(1.0), score)).where(F.col("tpl").isNull() | short | (F.col("score") >= COVER))
    return merged.select("row", "id", "n_words", "tpl", "label", (F.col("k") == SHORT).alias("base"), "start", "end", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    found = spans(docs, id_col, text_col, phrases, texts)
    start = F.when(F.col("base"), F.col("start")).cast("long")

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    span = F.when(F.col("tpl").isNotNull(), F.struct("start", "end", "label"))
    return (
        found.groupBy("row", "id")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if("base").cast("long").alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("tpl").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(span)).alias("spans"),
        )
        .withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ","))
        .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )
