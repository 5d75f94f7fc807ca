"""Language identification with hyperdimensional letter-trigram profiles.

Each letter of any script has a random vector of +1 and -1, drawn by a hash of its code
point. A trigram binds the vectors of its three letters, permuted (rotated) by their place,
into their element-wise product; a text bundles its trigrams into their sum; a language's
prototype bundles its training texts. A text goes to the language whose prototype has the
largest cosine with its bundle.

Bundles of a chunk of texts are one product of two matrices, the counts of its distinct
trigrams and their vectors, a block of trigrams at a time. They hold whole numbers and add
up in any order, so tasks hand on one vector for each language, and a model is as large as
the languages times the dimensions, whatever the number of documents or letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T

#: The symbol between words; other symbols are the code points of lower-cased letters.
GAP = 0
_BITS = 21
#: Distinct trigrams whose vectors are held at once, letters that a worker remembers, and
#: texts whose bundles are made at once: many texts can be a word long.
BLOCK, KNOWN, TEXTS = 2048, 8192, 512


@dataclass(frozen=True)
class LangId:
    """dims: length of the vectors, a multiple of 64. seed: of the letter vectors."""

    dims: int = 1024
    seed: int = 20408

    def __post_init__(self):
        if self.dims <= 0 or self.dims % 64:
            raise ValueError("dims must be a multiple of 64")


_TABLE: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Symbol of each code point: its lower-cased letter, or the gap."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((ord(c.lower()[0]) if (c := chr(n)).isalpha() else GAP for n in range(0x110000)), np.uint32, 0x110000)
    return _TABLE


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes, their rows, and the number of letters of each text.

    A run of anything but letters counts as one gap; every text begins and ends with one.
    """
    flat = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = symbols()[flat]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lens)
    letters = np.bincount(row[sym > 0], minlength=len(texts))
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    sym, row = np.concatenate(([GAP], sym[keep])).astype(np.int64), np.concatenate(([0], row[keep]))
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = (((sym[:-2] << _BITS) | sym[1:-1]) << _BITS) | sym[2:]
    # a trigram belongs to its middle letter's text; one centred on a gap spans two words
    mid = (sym[1:-1] > 0) | (row[:-2] == row[2:])
    return code[mid], row[1:-1][mid], letters


def letter_vectors(symbol: np.ndarray, p: LangId) -> np.ndarray:
    """A row of +1 and -1 for each symbol: the bits of hashes of the symbol and a counter."""
    words = np.arange(p.dims // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        own = T.mix(symbol.astype(np.uint64) + np.uint64(p.seed) * np.uint64(0x9E3779B97F4A7C15))
        bits = T.mix(own[:, None] + words * np.uint64(0xD1B54A32D192ED03))
    return (np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) << 1) - 1


class Vectors:
    """The vectors of trigrams; those of letters are remembered, up to KNOWN of them."""

    def __init__(self, p: LangId):
        self.p, self.at = p, np.zeros(0, np.int64)
        self.turned: list[np.ndarray] = []

    def of(self, codes: np.ndarray) -> np.ndarray:
        parts = [codes >> (2 * _BITS), (codes >> _BITS) & ((1 << _BITS) - 1), codes & ((1 << _BITS) - 1)]
        new = np.setdiff1d(np.concatenate(parts), self.at)
        if len(new):
            self.at = np.unique(np.concatenate(parts)) if len(self.at) + len(new) > KNOWN else np.union1d(self.at, new)
            v = letter_vectors(self.at, self.p)
            self.turned = [np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v]
        out = np.ones((len(codes), self.p.dims), np.int8)
        for part, v in zip(parts, self.turned, strict=True):
            out *= v[np.searchsorted(self.at, part)]
        return out


def bundles(texts: list[str], vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and its number of letters."""
    code, row, letters = trigrams(texts)
    out = np.zeros((len(texts), vectors.p.dims))
    known, which = np.unique(code, return_inverse=True)
    order = np.argsort(which, kind="stable")
    which, row = which[order], row[order]
    cuts = np.searchsorted(which, np.arange(0, len(known) + BLOCK, BLOCK))
    for n, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        size = min(BLOCK, len(known) - n * BLOCK)
        count = np.bincount(row[s:e] * size + which[s:e] - n * BLOCK, minlength=len(texts) * size).reshape(len(texts), size)
        # whole numbers of single precision are exact up to 2**24
        kind = np.float32 if e - s < 1 << 24 else np.float64
        out += count.astype(kind) @ vectors.of(known[n * BLOCK : n * BLOCK + size]).astype(kind)
    return out, letters


def _sums(p: LangId):
    """The bundle of each language in a task, a row for each dimension."""

    @T.lean
    def run(batches):
        vectors, sums = Vectors(p), {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for i, j in T.pieces(T.utf8(batch.column(1))[1], rows=TEXTS):
                found, _ = bundles(batch.column(1).slice(i, j - i).to_pylist(), vectors)
                names = {x: n for n, x in enumerate(sorted(set(lang[i:j])))}
                own = np.zeros((len(names), p.dims))
                np.add.at(own, [names[x] for x in lang[i:j]], found)
                for x, n in names.items():
                    sums[x] = sums[x] + own[n] if x in sums else own[n]
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * p.dims, pa.string()), pa.array(np.arange(p.dims, dtype=np.int32)), pa.array(total)], ["lang", "dim", "x"])

    return run


@dataclass
class Model:
    langs: list[str]
    protos: np.ndarray
    params: LangId


def fit(docs: DataFrame, p: LangId | None = None, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn the prototypes from all rows with a text and a language.

    What reaches the driver is a number for each language and dimension.
    """
    p = p or LangId()
    src = docs.select(T.column(docs, lang_col, "string").alias("lang"), T.column(docs, text_col, "string").alias("text")).where("lang is not null and text is not null")
    with T.small_batches(docs.sparkSession):
        found = src.mapInArrow(_sums(p), "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(found["lang"].unique())
    protos = np.zeros((len(langs), p.dims))
    protos[found["lang"].map({x: n for n, x in enumerate(langs)}).to_numpy(np.int64), found["dim"].to_numpy(np.int64)] = found["x"].to_numpy(np.float64)
    return Model(langs, protos, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, letters of every row.

    score is the largest cosine, cut to 0 .. 1; ties go to the first language by name;
    letters is how many the text has. A
    text that is null or has no letter, and any text under a model without languages, is
    `und` with score 0. An empty table gives an empty result.
    """
    keep = keep or []
    langs, p = model.langs, model.params
    size = np.linalg.norm(model.protos, axis=1, keepdims=True)
    # languages times dimensions
    shared = docs.sparkSession.sparkContext.broadcast(model.protos / np.where(size > 0, size, 1))
    source = docs.select(*(F.col(f"`{c}`") for c in keep), T.column(docs, text_col, "string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + "lang_pred string, score double, letters long"

    @T.lean
    def run(batches):
        protos, vectors = shared.value, Vectors(p)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in T.pieces(T.utf8(texts)[1], rows=TEXTS):
                found, letters = bundles(texts.slice(i, j - i).fill_null("").to_pylist(), vectors)
                pred, score = ["und"] * (j - i), np.zeros(j - i)
                norm = np.linalg.norm(found, axis=1)
                ok = (letters > 0) & (norm > 0) & bool(langs)
                if ok.any():
                    cosine = found[ok] / norm[ok, None] @ protos.T
                    score[ok] = np.clip(cosine.max(axis=1), 0, 1)
                    for n, best in zip(np.flatnonzero(ok), cosine.argmax(axis=1), strict=True):
                        pred[n] = langs[best]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)), pa.array(pred, pa.string()), pa.array(score), pa.array(letters.astype(np.int64))], [*keep, "lang_pred", "score", "letters"])

    return source.mapInArrow(run, schema)
