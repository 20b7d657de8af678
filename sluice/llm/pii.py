"""Personal data: candidate spans judged by gradient-boosted trees.

High-recall generators propose overlapping candidates.  The fixed kinds
(email, ip, card, phone) are exact patterns and always selected.  Looser kinds
(written-out addresses, local phone numbers, national ids, short cards, IPv6,
bank accounts) are judged by boosted trees on format features (digits,
groups, separators, checksums, neighbours) and context features (words before
the span); a kind's threshold is calibrated on held-out examples to a stated
precision.  Of overlapping selected candidates the most probable stays, and
none is added over a fixed span.

The trees are trained in a second from ``EXAMPLES`` labelled examples that a
seeded generator makes, so the model's size and cost never follow the corpus;
they are broadcast (a few kilobytes).  One pass over the texts, no shuffle;
texts without a digit, an at sign or an address in words are passed over.

Defined results: null and empty texts have no spans; offsets count code
points, ends are exclusive; fixed spans of one kind do not overlap, those of
different kinds may; repeated rows each get a row; an empty table gives an
empty table.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.boosting import Trees, fit
from sluice.llm.common import slices

BASE = ("email", "ip", "card", "phone")
LOOSE = ("written_email", "local_phone", "national_id", "short_card", "ipv6", "account")
KINDS = BASE + LOOSE
#: Labelled examples, and the held-out precision that a kind's threshold must reach.
EXAMPLES, PRECISION = 6000, 0.98

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]|[\[(\x20][Aa][Tt][\])\x20]")

_LOOSE_PATTERNS = {
    "written_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}(?![A-Za-z])", re.IGNORECASE),
    "local_phone": re.compile(r"(?<![A-Za-z0-9+.-])(?:0[1-9](?:[\x20.-][0-9]{2}){4}|\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?)(?![A-Za-z0-9-])"),
    "national_id": re.compile(r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    "short_card": re.compile(r"(?<![A-Za-z0-9.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![A-Za-z0-9-])"),
    "ipv6": re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
}
#: Context words in English, German, French and Spanish: fixed values.
WORDS = {
    "contact": "call phone tel telephone mobile cell fax ring text contact reach anrufen telefon ruf rufen handy mobil kontakt erreichbar appeler appelez appel téléphone portable joindre llame llamar llamada teléfono móvil contacto",
    "mail": "mail e-mail email write contact reach address schreiben schreib adresse kontakt courriel écrire écrivez correo escriba escribir dirección",
    "identity": "ssn social security national passport tax id ausweis steuer versicherung sécurité identité passeport seguridad identidad pasaporte dni nif",
    "payment": "card visa amex credit debit iban account bank payment pay paid karte kreditkarte konto bankverbindung zahlung carte compte paiement virement tarjeta cuenta pago",
    "network": "ip ipv6 host address server ping dns rechner serveur servidor",
    "other": "order invoice version isbn issn ref page pages sku part serial date dated range ticket model chapter mac bestellung rechnung seite kapitel modell commande facture chapitre modèle pedido factura página capítulo modelo",
}
_CONTEXT = {kind: re.compile(rf"\b(?:{'|'.join(words.split())})\b") for kind, words in WORDS.items()}
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost, not overlapping; each at sign is looked at once, so long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds, by kind as listed, then start."""
    out = list(_emails(text)) if "@" in text else []
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Loose candidates; they may overlap."""
    return [(m.start(), m.end(), kind) for kind, pattern in _LOOSE_PATTERNS.items() for m in pattern.finditer(text)]


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def features(text: str, a: int, b: int, kind: str) -> list[float]:
    """Format of the span and context around it."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    before = text[max(0, a - REACH) : a].lower()
    return [
        float(LOOSE.index(kind)), b - a, len(digits), sum(c.isalpha() for c in s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("-"), s.count("."), s.count(" "), s.count("("), s.count(":"), float(luhn(digits) if digits else 0), float(digits[:1] in ("0", "1")), float(len(set(digits))),
        float(bool(re.search(r"(?:19|20)[0-9]{2}", s))), float(groups[-1].lower() in ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk") if groups else 0),
        float(_side(text[a - 1 : a])), float(_side(text[b : b + 1])), *(float(bool(p.search(before))) for p in _CONTEXT.values()),
    ]


def _with_luhn(rng: random.Random, n: int, ok: bool) -> str:
    body = "".join(rng.choice("3456") if i == 0 else str(rng.randrange(10)) for i in range(n - 1))
    good = next(d for d in "0123456789" if luhn(body + d))
    return body + (good if ok else str((int(good) + rng.randrange(1, 10)) % 10))


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """``n`` labelled candidates (text, start, end, kind, label) from a seeded generator."""
    rng = random.Random(seed)
    d = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    fitting = {"written_email": "mail", "local_phone": "contact", "national_id": "identity", "short_card": "payment", "ipv6": "network", "account": "payment"}
    words = {kind: own.split() for kind, own in WORDS.items()}

    def lead(kind: str, label: int) -> str:
        """Words before the span: mostly what fits the label, at times the contrary or nothing."""
        x = rng.random()
        own = words[fitting[kind]] if label else words["other"]
        contrary = words["other"] if label else words[fitting[kind]]
        first = "" if x < (0.15 if label else 0.4) else rng.choice(contrary if x > (0.97 if label else 0.98) else own)
        return first + rng.choice(["", ":", f" {w()}", f" {w()} {w()}", " no", " nr."]) if first else w()

    def good(kind: str) -> str:
        sep = rng.choice("- .")
        return {
            "written_email": lambda: f"{w()}{rng.choice(['.', '', '_'])}{w()}{rng.choice([' at ', ' (at) ', '(at)', ' [at] '])}{w()}{rng.choice([' dot ', '(dot)', ' [dot] ', '.'])}{rng.choice(['com', 'org', 'net', 'de'])}",
            "local_phone": lambda: rng.choice([f"({rng.randint(200, 989)}) {d(3)}-{d(4)}", f"{rng.randint(200, 989)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{rng.choice('6789')}{d(2)}{sep}{d(3)}{sep}{d(3)}", f"0{rng.randint(1, 9)}{sep}" + sep.join(d(2) for _ in range(4)), f"0{d(2)} {d(4)} {d(3)}"]),
            "national_id": lambda: f"{rng.randint(100, 799)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
            "short_card": lambda: _with_luhn(rng, rng.choice((13, 14, 15)), True),
            "ipv6": lambda: ":".join(hexa(rng.randint(3, 4)) for _ in range(8)),
            "account": lambda: rng.choice(("DE", "FR", "ES", "GB")) + d(2) + rng.choice(("", " ")).join(["", *(d(4) for _ in range(rng.randint(4, 5)))]),
        }[kind]()

    def bad(kind: str) -> str:
        return {
            "written_email": lambda: f"{w()} at {w()}. {w()}",
            "local_phone": lambda: rng.choice([f"{rng.randint(1900, 2030)}-{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)} {d(3)} {d(3)}", f"{rng.choice('12345')} {d(3)} {d(3)}"[2:] + f" {d(3)}", f"978-{d(3)}-{d(4)}"]),
            "national_id": lambda: rng.choice([f"000-{d(2)}-{d(4)}", f"9{d(2)}-00-{d(4)}", f"{d(3)}-{d(2)}-{rng.randint(1900, 2030)}"]),
            "short_card": lambda: _with_luhn(rng, rng.choice((13, 14, 15)), False),
            "ipv6": lambda: ":".join(rng.choice((d, hexa))(2) for _ in range(rng.randint(5, 8))),
            "account": lambda: "".join(rng.choice("ABCDEFXYZ") for _ in range(2)) + d(2) + "".join(rng.choice("ABCDEFGH0123") for _ in range(4 * rng.randint(3, 4))),
        }[kind]()

    out: list[tuple[str, int, int, str, int]] = []
    while len(out) < n:
        kind, label = rng.choice(LOOSE), rng.randrange(2)
        alike = not label and rng.random() < 0.15 and kind not in ("written_email", "ipv6")  # the same form, something else
        span = good(kind) if label or alike else bad(kind)
        before = f"{rng.choice(words['other'])} {w()}" if alike else lead(kind, label)
        text = f"{w()} {w()} {before} {span}{rng.choice(['', '.', ','])} {w()}"
        for a, b, k in candidates(text):
            if k == kind and len(out) < n:
                out.append((text, a, b, k, label))
    return out


@functools.lru_cache(maxsize=1)
def model(n: int = EXAMPLES, precision: float = PRECISION) -> tuple[Trees, dict[str, float]]:
    """Trees from two thirds of the examples, and by kind the least threshold that is precise enough on the rest."""
    every = examples(n)
    x = np.array([features(t, a, b, k) for t, a, b, k, _ in every])
    y = np.array([float(label) for *_, label in every])
    held = np.arange(len(y)) % 3 == 2
    trees = fit(x[~held], y[~held])
    p = trees.probability(x[held])
    thresholds = {}
    for no, kind in enumerate(LOOSE):
        own = x[held][:, 0] == no
        tried = sorted(set(np.round(p[own], 4)) | {0.5})
        fine = [c for c in tried if c >= 0.5 and (chosen := p[own] >= c).any() and y[held][own][chosen].mean() >= precision]
        thresholds[kind] = float(fine[0]) if fine else 1.01
    return trees, thresholds


def find(text: str, trees: Trees, thresholds: dict[str, float]) -> list[tuple[int, int, str]]:
    """All spans by kind as listed, then start."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    loose = candidates(text)
    if loose:
        p = trees.probability(np.array([features(text, *c) for c in loose]))
        fixed = merged(base)
        taken: list[tuple[int, int, str]] = []
        order = sorted((i for i in range(len(loose)) if p[i] >= thresholds[loose[i][2]]), key=lambda i: (-p[i], loose[i]))
        free = np.ones(len(text) + 1, bool)
        for a, b, _ in fixed:
            free[a:b] = False
        for i in order:
            a, b, _ = loose[i]
            if free[a:b].all():
                free[a:b] = False
                taken.append(loose[i])
        base = base + sorted(taken, key=lambda s: (KINDS.index(s[2]), s[0]))
    return base


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Disjoint spans; overlapping ones become one, of the kind of the longest."""
    out: list[tuple[int, int, str]] = []
    longest = 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            x, y, k = out[-1]
            out[-1] = (x, max(y, b), kind if b - a > longest else k)
            longest = max(longest, b - a)
        else:
            out.append((a, b, kind))
            longest = b - a
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each merged span replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in merged(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _broadcast(spark: SparkSession):
    return spark.sparkContext.broadcast(model())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_email, n_ip, n_card, n_phone, n_loose, base_sha256, spans."""
    known = _broadcast(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = known.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches, "text"):
            counts = {k: [0] * batch.num_rows for k in (*BASE, "loose")}
            digests, shown = [nothing] * batch.num_rows, [""] * batch.num_rows
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = find(text, trees, thresholds) if text else []
                if found:
                    for _, _, k in found:
                        counts[k if k in BASE else "loose"][i] += 1
                    named = [f"{k}:{a}:{b}" for a, b, k in found]
                    n = sum(k in BASE for _, _, k in found)
                    digests[i] = hashlib.sha256(",".join(named[:n]).encode()).hexdigest()
                    shown[i] = ",".join(named)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests), pa.array(shown)],
                names=["id", *(f"n_{k}" for k in counts), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_loose long, base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text; same columns, the length brought up to date."""
    known = _broadcast(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = known.value
        for batch in slices(batches, f"c{at}"):
            texts = batch.column(f"c{at}").to_pylist()
            changed = [False] * len(texts)
            for i, text in enumerate(texts):
                if text and (found := find(text, trees, thresholds)):
                    texts[i] = redact(text, found)
                    changed[i] = True
            cols = [pa.array(texts, batch.schema.field(j).type) if j == at else batch.column(j) for j in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(changed)], names=[*batch.schema.names, "changed"])

    out = plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("changed", T.BooleanType())]))
    cols = []
    for i, name in enumerate(names):
        c = F.col(f"c{i}")
        cols.append(F.when(F.col("changed"), F.char_length(f"c{at}").cast(docs.schema[name].dataType)).otherwise(c) if name == length_col else c)
    return out.select(*cols).toDF(*names)
