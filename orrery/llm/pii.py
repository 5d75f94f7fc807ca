"""Personal data: expressions propose spans, checksums confirm them, context adjusts a score.

Kinds: email, ip, card (Luhn), phone, iban (mod 97), secret (long keys and tokens). The
first four follow fixed base rules and stay whatever their score. The method adds the other
two, and there the score decides: a confirmed IBAN goes where the words on both sides tell
of something else, and a long code, which no checksum confirms, is a secret only beside a
word that says so. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: The kinds of the base rules.
BASE = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_LONG = "[A-Za-z0-9_+/=-]{20}"
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Pii:
    """window: code points on each side searched for context words; words that it cuts don't count.

    Scores are in hundredths. A kind starts at base_score. Each side with a context word of
    the kind adds step; if neither has one, each side with a word of another kind takes it
    away. Spans of the method's own kinds stay from min_score on, those of BASE always.
    """

    window: int = 40
    step: int = 20
    min_score: int = 50
    base_score: dict = field(default_factory=lambda: {"email": 90, "ip": 70, "card": 80, "phone": 70, "iban": 70, "secret": 40})
    context: dict = field(
        default_factory=lambda: {
            "email": frozenset("mail email contact correo courriel".split()),
            "ip": frozenset("ip address host server".split()),
            "card": frozenset("card visa mastercard credit karte carte tarjeta".split()),
            "phone": frozenset("phone call tel mobile telefon fax".split()),
            "iban": frozenset("iban account bank konto compte cuenta".split()),
            "secret": frozenset("token secret password passwd pwd key apikey api_key credential credentials bearer".split()),
        }
    )


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN without spaces has remainder 1."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _iban(text: str):
    for m in _IBAN.finditer(text):
        parts, code = m.group().split(" "), m.group()
        # a following word may look like one more block: the longest valid run of blocks counts
        while parts:
            code = " ".join(parts)
            if 15 <= len(packed := code.replace(" ", "")) <= 34 and mod97(packed):
                yield m.start(), m.start() + len(code)
                break
            parts.pop()


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        digits = sum(map(str.isdigit, m.group()))
        if digits >= 3 and sum(map(str.isalpha, m.group())) >= 3:
            yield m.start(), m.end()


def _told(text: str, begin: int, end: int, p: Pii) -> set[str]:
    """The kinds that the whole words between two places tell of."""
    while 0 < begin < end and text[begin - 1].isalnum() and text[begin].isalnum():
        begin += 1
    while begin < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end -= 1
    words = set(_WORD.findall(text[begin:end].lower()))
    return {kind for kind, names in p.context.items() if names & words}


def _score(text: str, s: int, kind: str, e: int, p: Pii) -> int:
    sides = (_told(text, max(0, s - p.window), s, p), _told(text, e, min(len(text), e + p.window), p))
    own, other = (sum(map(bool, x)) for x in zip(*((kind in t, t - {kind}) for t in sides), strict=True))
    return min(100, max(0, p.base_score[kind] + p.step * (own or -other)))


def find(text: str, p: Pii, codes: bool = True) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of the personal data in a text, by start and then kind.
    codes: whether the text may hold a run long enough for a secret."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(v := x.lstrip("0")) <= 3 and int(v or 0) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
        found += [(s, 4, e) for s, e in _iban(text)]
        if codes:
            known = list(found)
            found += [(s, 5, e) for s, e in _secrets(text) if not any(x < e and s < y for x, _, y in known)]
    out = []
    for s, k, e in sorted(found):
        score = _score(text, s, KINDS[k], e, p)
        if KINDS[k] in BASE or score >= p.min_score:
            out.append((s, KINDS[k], e, score / 100))
    return out


def _rows(run):
    """A function over batches that gets rows of modest size: the columns before the text, texts, their spans."""

    def over(p: Pii):
        @T.lean
        def mapped(batches):
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                codes = pc.match_substring_regex(column, _LONG).to_pylist()
                for i, j in T.pieces(T.utf8(column)[1], 8 * T.CHUNK_BYTES):
                    texts = column.slice(i, j - i).to_pylist()
                    spans = [find(t, p, c) if t else [] for t, c in zip(texts, codes[i:j], strict=True)]
                    yield run(batch.slice(i, j - i).select(batch.schema.names[:-1]), texts, spans)

        return mapped

    return over


_SPANS = "spans array<struct<kind:string, start:int, end:int, score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


@_rows
def _listed(batch, texts, spans):
    return _with(batch, spans=pa.array([[{"kind": k, "start": s, "end": e, "score": v} for s, k, e, v in x] for x in spans], _SPAN))


@_rows
def _masked(batch, texts, spans):
    listed = pa.array([[{"kind": k, "start": s, "end": e, "score": v} for s, k, e, v in x] for x in spans], _SPAN)
    return _with(batch, spans=listed, masked=pa.array([t if t is None else mask(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))


@_rows
def _digested(batch, texts, spans):
    counts = {f"n_{k}": pa.array([sum(x[1] == k for x in found) for found in spans], pa.int64()) for k in BASE}
    said = [[(k, f"{k}:{s}:{e}") for s, k, e, _ in found] for found in spans]
    base = [hashlib.sha256(",".join(x for k, x in found if k in BASE).encode()).hexdigest() for found in said]
    every = [",".join(x for _, x in found) for found in said]
    scores = [",".join(f"{v:.2f}" for *_, v in found) for found in spans]
    return _with(batch, **counts, base_sha256=pa.array(base, pa.string()), spans=pa.array(every, pa.string()), scores=pa.array(scores, pa.string()))


def mask(text: str, spans: list[tuple[int, str, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    out, done, at = [], 0, 0
    merged: list[list] = []
    for s, k, e, _ in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[done:s], f"<{k.upper()}>"]
        done = at = e
    return "".join(out) + text[at:]


def detect(docs: DataFrame, p: Pii | None = None, id_col: str = "doc_id", text_col: str = "text", masked: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``keep`` (none named spans or masked),
    spans (kind, start, end, score), and the masked text if asked for.

    A null or empty text has no spans (its masked text stays null or empty). Rows are
    independent: repeated rows and null ids are kept as they are, other columns are
    ignored, and an empty table gives an empty result.
    """
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), *(F.col(f"`{c}`") for c in keep), T.column(docs, text_col, "string").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:-1])
    return src.mapInArrow((_masked if masked else _listed)(p or Pii()), f"doc_id long, {kept}{_SPANS}" + ", masked string" * masked)


def digest(docs: DataFrame, p: Pii | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, as by ``detect``: counts per base kind, a hash of the base spans,
    all spans as kind:start:end, and their scores in the same order."""
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), T.column(docs, text_col, "string").alias("__text"))
    return src.mapInArrow(_digested(p or Pii()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
