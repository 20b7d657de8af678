"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths decides the packing, and it has at most
``capacity`` entries however many documents there are.  The driver fills one
bin at a time: the longest length left is fixed, and a subset-sum program over
the lengths still available (sets of reachable sums are the bits of one
integer, a length with many pieces enters by doublings) finds the fullest
combination beside it.  The combination is a pattern; it is removed as often
as its rarest length allows, so there are few patterns, and their number
follows the lengths, not the documents.

Pieces get a rank within their length by salted prefix counts, a part for each
``RANKED`` pieces of a length or ``1/PARTS`` of all; pattern use tables turn (length, rank) into a
sequence and an offset.  No sort or window ever holds all pieces of a frequent
length.  Both tables are broadcast: the parts are at most one per length and
``PARTS`` more, and a length ends at most 1 + capacity / length patterns,
which is about 19,000 patterns at a capacity of 2048 whatever the documents.

Tokenising keeps a bounded table from words to their tokens, which is exact
because the tokenizer drops white space and never merges across it.

Defined results: a null or empty text is its end token alone; a document is
cut only if it is longer than a sequence; repeated rows are packed each; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import stored

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Words whose tokens a worker remembers at once.
REMEMBERED = 800_000
#: ASCII punctuation without the apostrophe, with which the tokenizer begins contractions.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces of one length that are ranked by one task, at least, and parts of all pieces, about.
RANKED, PARTS = 500, 10_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts, as little-endian uint32 bytes, word by word.

    Text is cut at white space, and before a comma or full stop that ends a
    word, where the tokenizer's split pattern cuts too; it is lower-cased first
    where that is what the tokenizer does letter by letter.  Few distinct words
    remain, and their tokens are remembered in a table that is emptied when it
    is full, which only costs time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[no for w, no in words.items() if w.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        words = list(map(cut_words, texts))
        known = self.known
        new = set(itertools.chain.from_iterable(words)).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(itertools.chain.from_iterable(words))
        self._learn(new)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def _learn(self, new: set[str]) -> None:
        """Tokenize the words; one of letters with punctuation after it, by its two parts."""
        known = self.known
        cut = {w: (head, w[len(head) :]) for w in new if not w.isalpha() and (head := w.rstrip(PUNCTUATION)) != w and _splits(head)}
        plain = [w for w in new if w not in cut]
        plain += {p for pair in cut.values() for p in pair}.difference(known, plain)
        letters = [w for w in plain if w.isalpha()]
        for at in range(0, len(letters), 5_000):
            step = letters[at : at + 5_000]
            ids = np.asarray(self.tokenizer.encode(" ".join(step), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(step):  # each word ends in one token that ends a word
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                known.update(zip(step, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                self._one_by_one(step)
        self._one_by_one([w for w in plain if not w.isalpha()])
        for w, (head, tail) in cut.items():
            known[w] = known[head] + known[tail]

    def _one_by_one(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)


#: Characters whose lower case or white space depends on more than the character.
_UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
#: A comma or full stop that ends a run of several symbols, which is one token to split.
_RUN = re.compile(r"(?:[^\w\s]|_)[.,]\s")


def cut_words(text: str) -> list[str]:
    """Parts of a text that the tokenizer never joins, in order."""
    if _UNUSUAL.search(text):
        return [w.decode() for w in text.encode().split()]  # at ASCII white space only
    text = text.lower()
    if not _RUN.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
    return text.split()


def _splits(head: str) -> bool:
    """Whether punctuation after the letters is split off: not after one that the tokenizer turns into a letter and a
    mark, by its lower case (U+0130) or its normal form (U+0958)."""
    return head.isalpha() and unicodedata.normalize("NFC", head.lower()).isalpha()


_encoders: dict[str, WordEncoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
    end = np.uint32(END).tobytes()
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            ids, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, tokens in zip(part.column("id").to_pylist(), encoder.encode(texts), strict=True):
                tokens += end
                for no, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    own = tokens[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(no)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("id").type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Available lengths with the greatest sum of at most ``room``, the longest lengths preferred.

    Bit s of the state is set when sum s is reachable; each step keeps the
    state before it, and the steps are read back from the best sum.
    """
    mask = (1 << (room + 1)) - 1
    state, steps = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            use = min(size, left)
            steps.append((length, use, state))
            state |= (state << (length * use)) & mask
            left -= use
            size *= 2
        if state >> room:
            break
    best, out = state.bit_length() - 1, []
    for length, use, before in reversed(steps):
        if not before >> best & 1:
            best -= length * use
            out += [length] * use
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins), filling bins by minimum slack until no piece is left."""
    left = dict(histogram)
    out = []
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            combination = Counter([longest, *fullest(left, capacity - longest)])
            left[longest] += 1
            times = min(left[n] // use for n, use in combination.items())
            for n, use in combination.items():
                left[n] -= times * use
            out.append((tuple(sorted(combination.elements(), reverse=True)), times))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that drops white space and
    splits at it; the default is the public word-level file.
    """
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    cut = stored(source.mapInArrow(lambda b: _pieces(b, path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    pieces = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    held_by_one = max(RANKED, sum(pieces.values()) // PARTS)  # so there are at most capacity + PARTS parts
    parts = {length: 1 + n // held_by_one for length, n in pieces.items()}
    split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, k in parts.items() if k > 1 for x in (n, k)]), F.col("length")), F.lit(1)) if max(parts.values(), default=1) > 1 else F.lit(1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), split).cast("int"))

    held = sorted(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect())
    before, histogram = [], {}
    for length, group in itertools.groupby(held, key=lambda r: r[0]):
        seen = 0
        for r in group:
            before.append((length, r.salt, seen))
            seen += r.n
        histogram[length] = seen
    uses, used, first = [], dict.fromkeys(histogram, 0), 0
    bins = patterns(histogram, capacity)
    # a pattern leaves fewer pieces of some length than it holds, so a length ends at most 1 + capacity / length of them
    assert len(bins) <= sum(1 + capacity // n for n in histogram)
    for lengths, times in bins:
        at = 0
        for length in lengths:
            uses.append((length, used[length], used[length] + times, first, at))
            used[length] += times
            at += length
        first += times

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")) - 1
    offsets = spark.createDataFrame(before or [(0, 0, 0)], "length long, salt int, seen long")
    ranked = salted.withColumn("no", rank).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("seen") + F.col("no"))
    # the uses of one length as one sorted array: a row finds its own by its rank
    table = spark.createDataFrame(uses or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    by = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("uses"))
    own = F.filter("uses", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]
    placed = ranked.join(F.broadcast(by), "length").withColumn("own", own)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("own.first") + F.col("rank") - F.col("own.low")).alias("sequence_id"), F.col("own.offset").alias("offset"),
    )
