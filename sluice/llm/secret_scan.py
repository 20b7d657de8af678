"""Secret scan: fixed patterns and sliding-window entropy.

Candidate strings are runs of key characters.  Over each, a window slides; the
Shannon entropy of its characters is kept up to date from the counts of the
character that enters and the one that leaves.  A window is hot when its
entropy reaches the threshold of its character class (hexadecimal, letters and
digits, or base64) and it mixes digits and letters; hot windows merge into
spans.  An allow list cuts well-known harmless parts (UUIDs, placeholder words,
digests of nothing, slugs and paths) out of a candidate, and the windows slide
over what is left, so a harmless part never hides the secret beside it; nor does
a fixed span.  The fixed patterns (assignments, access keys, long lower-case
hexadecimal) are never suppressed.

One pass, no shuffle.  Runs are found with numpy over whole batches; only
texts with a run, an access-key prefix, or a colon or equals sign are looked at
one by one.

Defined results: null and empty texts have no spans; offsets count code
points, ends are exclusive; spans of one kind do not overlap; repeated rows
each get a row; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import byte_class, slices, text_buffer, word_bounds

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits per character of a window, by class.
LEAST = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}

_HEX_BYTES = byte_class((0x30, 0x39), (0x61, 0x66))
_KEY_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3D, 0x3D), (0x5F, 0x5F))
_HEX_SET = frozenset("0123456789abcdefABCDEF")

#: Harmless parts of a candidate, which are cut out of it: UUIDs, digests of nothing, placeholder words that stand
#: alone, and chains of words and numbers (slugs, paths, snake case).
_PART = r"(?:[a-z]+|[A-Z][a-z]*|[A-Z]{2,}|[0-9]{1,12}|[A-Za-z][a-z]*[0-9]{1,4})"
ALLOWED = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
    r"|d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709"
    r"|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    r"|(?<![A-Za-z])(?i:example|placeholder|changeme|your|dummy|sample|x{4,})(?![A-Za-z])"
    rf"|(?<![A-Za-z0-9])(?:{_PART}[-_/=+])+{_PART}(?![A-Za-z0-9])"
)
#: Least length of a chain that is cut out; a shorter one may stand in a key by chance.
CHAIN = 8
_ROWS = "abcdefghijklmnopqrstuvwxyz0123456789abcdefghijklmnopqrstuvwxyz"


def entropy_windows(s: str, width: int = WINDOW) -> Iterator[tuple[int, float]]:
    """(start, entropy in bits per character) of every window, by incremental counts."""
    n = min(width, len(s))
    if not n:
        return
    term = [0.0, *(c * math.log2(c) for c in range(1, n + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        if i >= n:
            d = s[i - n]
            k = counts[d]
            counts[d] = k - 1
            total += term[k - 1] - term[k]
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
        if i >= n - 1:
            yield i - n + 1, math.log2(n) - total / n


def _class(window: str) -> str:
    if _HEX_SET.issuperset(window):
        return "hex"
    return "alnum" if window.isalnum() else "base64"


def hot_spans(s: str, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of ``s`` whose entropy reaches their class's threshold and that mix their characters.

    Mixed: three digits and three letters, or one digit and letters of both cases.
    """
    sums = [np.concatenate([[0], np.cumsum([f(c) for c in s])]).tolist() for f in (str.isdigit, str.islower, str.isupper)]
    out: list[tuple[int, int]] = []
    for a, bits in entropy_windows(s, width):
        b = min(a + width, len(s))
        if bits < LEAST["hex"]:
            continue
        digits, lower, upper = (x[b] - x[a] for x in sums)
        if not (digits >= 3 and lower + upper >= 3 or digits and lower and upper):
            continue
        if bits >= LEAST[_class(s[a:b])]:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def allowed(s: str) -> list[tuple[int, int]]:
    """Harmless parts (start, end) of a candidate, in order."""
    return [m.span() for m in ALLOWED.finditer(s) if m.end() - m.start() >= CHAIN or m[0].isalpha()]


def harmless(s: str) -> bool:
    """Whether a span is a stretch of the alphabet."""
    low = s.lower()
    return low in _ROWS or low in _ROWS[::-1]


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start, then kind as in ``KINDS``."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    covered: list[tuple[int, int]] = []
    for a, b, _ in sorted(out):
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    for m in CANDIDATE.finditer(text):
        # what is left of the candidate between fixed spans and harmless parts
        first = max(bisect.bisect_left(covered, (m.start(), 0)) - 1, 0)
        last = bisect.bisect_left(covered, (m.end(), 0))
        at = m.start()
        for a, b in [*sorted([*((x + m.start(), y + m.start()) for x, y in allowed(m[0])), *covered[first:last]]), (m.end(), m.end())]:
            if min(a, m.end()) - at >= WINDOW:
                spans = [(x + at, y + at) for x, y in hot_spans(text[at : min(a, m.end())])]
                out += [(x, y, "entropy") for x, y in spans if not harmless(text[x:y])]
            at = max(at, b)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can have a span: a superset of them, found over the whole batch."""
    rows = [np.searchsorted(offsets, np.flatnonzero((data == 0x3A) | (data == 0x3D)), side="right") - 1]
    for inside, least in ((_HEX_BYTES, 24), (_KEY_BYTES, 20)):
        starts, ends, _ = word_bounds(data, offsets, inside)
        rows.append(np.searchsorted(offsets, starts[ends - starts >= least], side="right") - 1)
    return np.unique(np.concatenate(rows))


def digest(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds).encode()).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = digest([], KINDS)
    for batch in slices(batches, "text"):
        n = batch.num_rows
        data, offsets = text_buffer(batch.column("text"))
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        digests, shown = [nothing] * n, [""] * n
        texts = batch.column("text")
        for i in _suspects(data, offsets).tolist():
            found = find(texts[i].as_py())
            for _, _, k in found:
                counts[k][i] += 1
            digests[i] = digest(found, KINDS[:3])
            shown[i] = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(counts[k]) for k in KINDS), pa.array(digests), pa.array(shown)], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
