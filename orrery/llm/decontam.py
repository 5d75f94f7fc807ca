"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. A scan of the corpus looks for the test items' word n-grams and counts each one's
   spread: the number of different surroundings (two words on either side) it has in the
   whole corpus. Copies of a passage share their surroundings, so being copied does not
   make an n-gram common.
2. An item's seeds are its n-grams of small spread, and in any case the rarer half of
   them. An item of fewer words than an n-gram is one seed with all its words, if that is rare. A second scan joins texts to items by seeds; where two or more seeds of an item
   lie close together, the item is aligned with that part of the text, word by word.
   Passages are never shuffled: both scans hold the item side, which is read in slices
   of a fixed size, however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T


@dataclass(frozen=True)
class Decontamination:
    """size: words of a seed. similarity: alignment score over the score of a full copy.

    An n-gram is rare with at most max(spread_least, spread_share * texts) surroundings.
    slice_chars bounds the test items held by a task at once.
    """

    size: int = 3
    similarity: float = 0.45
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    spread_least: int = 16
    spread_share: float = 1e-4
    slice_chars: int = 16_000_000


def tokens(column: pa.Array):
    """Chunks of rows with their word hashes and rows; case and punctuation don't count.

    A text whose lower case has another byte length keeps its letters, so that places hold.
    """
    low = pc.utf8_lower(column)
    data, off = T.utf8(pc.if_else(pc.equal(pc.binary_length(low), pc.binary_length(column)), low, column))
    for i, j in T.pieces(off):
        h, row, start, end = T.words(data[off[i] : off[j]], off[i : j + 1] - off[i], T.PUNCTUATION)
        yield i, j, h, row, start + off[i], end + off[i]


def grams(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the n-grams within rows (a shorter row has none)."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:m]
    with np.errstate(over="ignore"):
        for k in range(1, size):
            g = T.mix(g * T.U64(0x9E3779B97F4A7C15) + h[k : m + k])
    at = np.flatnonzero(row[:m] == row[size - 1 :])
    return g[at], at


def smith_waterman(a: np.ndarray, b: np.ndarray, p: Decontamination) -> tuple[int, int, int]:
    """Best local score of two word sequences with linear gaps, and the part of ``b`` it covers."""
    n = len(b)
    slope = np.arange(n + 1, dtype=np.int64) * -p.gap
    place = np.arange(n + 1, dtype=np.int64)
    h, begin = np.zeros(n + 1, np.int64), place.copy()
    best, where = 0, (0, 0)
    for x in a:
        diagonal = np.zeros(n + 1, np.int64)
        diagonal[1:] = h[:-1] + np.where(b == x, p.match, p.mismatch)
        from_diagonal = np.concatenate(([0], begin[:-1]))
        down = h + p.gap
        t = np.maximum(np.maximum(diagonal, down), 0)
        first = np.where(t == 0, place, np.where(diagonal >= down, from_diagonal, begin))
        lifted = t + slope
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, place, 0))
        across = run - slope
        h, begin = np.where(across > t, across, t), np.where(across > t, first[source], first)
        k = int(h.argmax())
        if h[k] > best:
            best, where = int(h[k]), (int(begin[k]), k)
    return best, *where


class Items:
    """The test items of one slice, indexed by their n-grams."""

    def __init__(self, ids: list, texts: list[str], size: int):
        self.ids = list(ids)
        # items without an id are told apart by their texts
        self.marks = [0 if d is not None else int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for d, t in zip(ids, texts, strict=True)]
        col = pa.array(texts, pa.string())
        parts = [(h, row + i) for i, _, h, row, _, _ in tokens(col)]
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        row = np.concatenate([r for _, r in parts]) if parts else np.zeros(0, np.int64)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        self.words = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        number = np.diff(cut)
        #: The sizes of seeds: items with fewer words have one of their own.
        self.sizes = sorted({min(int(n), size) for n in number if n})
        self.short = number < size
        pairs = [np.zeros((0, 2), np.uint64)]
        for s in self.sizes:
            g, at = grams(h, row, s)
            mine = (number[row[at]] == s) | (s == size)
            pairs.append(np.stack([g[mine], row[at[mine]].astype(np.uint64)], axis=1))
        pair = np.unique(np.concatenate(pairs), axis=0)
        self.gram, self.item = pair[:, 0].copy(), pair[:, 1].astype(np.int64)
        self.keys = np.unique(self.gram)

    def seeds(self, grams_seen: np.ndarray, spread: np.ndarray, most: int) -> "Items":
        """Keep the rare n-grams and the rarer half of each item's, but for items that are one n-gram; spread
        tells in how many surroundings each of ``grams_seen`` stands."""
        s = np.zeros(len(self.gram), np.int64)
        if len(grams_seen):
            order = np.argsort(grams_seen)
            at = order[np.minimum(np.searchsorted(grams_seen, self.gram.view(np.int64), sorter=order), len(order) - 1)]
            s = np.where(grams_seen[at] == self.gram.view(np.int64), spread[at], 0)
        order = np.lexsort((self.gram, s, self.item))
        rank = np.empty(len(s), np.int64)
        first = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        rank[order] = np.arange(len(s)) - first[self.item[order]]
        number = np.bincount(self.item, minlength=len(self.ids))
        keep = (s <= most) | ((2 * rank < number[self.item]) & ~self.short[self.item])
        self.gram, self.item = self.gram[keep], self.item[keep]
        self.keys = np.unique(self.gram)
        return self


def _surroundings(items):
    @T.lean
    def run(batches):
        keys = items.value.keys
        for batch in batches:
            found = [np.zeros((0, 2), np.uint64)]
            for _, _, h, row, _, _, size in ((*x, s) for x in tokens(batch.column(0)) for s in items.value.sizes):
                g, at = grams(h, row, size)
                if len(g) == 0 or len(keys) == 0:
                    continue
                hit = keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g
                g, at = g[hit], at[hit]
                around = np.zeros(len(g), np.uint64)
                with np.errstate(over="ignore"):
                    for k in (-2, -1, size, size + 1):
                        n = np.clip(at + k, 0, len(h) - 1)
                        inside = (at + k >= 0) & (at + k < len(h)) & (row[n] == row[at])
                        around = T.mix(around * T.U64(31) + np.where(inside, h[n], T.U64(0)))
                found.append(np.stack([g, around], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(T.i64(pairs[:, 0].copy())), pa.array(T.i64(pairs[:, 1].copy()))], ["g", "around"])

    return run


_HITS = "doc_id long, item_id long, similarity double, doc_start int, doc_end int, item_words int, seeds int, mark long"


class Aligner:
    """Finds the copies of a slice's items in columns of texts."""

    def __init__(self, it: Items, p: Decontamination):
        self.it, self.p = it, p
        order = np.argsort(it.gram, kind="stable")
        self.gram, self.item = it.gram[order], it.item[order]
        self.number = np.bincount(it.item, minlength=len(it.ids))

    def __call__(self, column: pa.Array):
        """(row, item, similarity, first byte, end byte, seeds) of each passage that is similar enough."""
        it, p, gram, item, number = self.it, self.p, self.gram, self.item, self.number
        base = T.utf8(column)[1]
        for i, _, h, row, start, end in tokens(column):
            parts = [grams(h, row, s) for s in it.sizes]
            g, at = (np.concatenate([x[n] for x in parts]) if parts else np.zeros(0, np.uint64) for n in (0, 1))
            if len(g) == 0 or len(gram) == 0:
                continue
            lo, hi = np.searchsorted(gram, g, "left"), np.searchsorted(gram, g, "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if len(at) == 0:
                continue
            which = item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at, n)
            r = row[at]
            order = np.lexsort((at, which, r))
            at, which, r = at[order], which[order], r[order]
            span = np.array([len(w) for w in it.words], np.int64)[which]
            new = np.ones(len(at), bool)
            new[1:] = (r[1:] != r[:-1]) | (which[1:] != which[:-1]) | (at[1:] - at[:-1] > 2 * span[1:])
            cuts = np.append(np.flatnonzero(new), len(at))
            text_from = np.searchsorted(row, np.arange(row[-1] + 2))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                k, x = int(which[s]), int(r[s])
                if e - s < min(2, number[k]):
                    continue
                m = len(it.words[k])
                a = max(int(text_from[x]), int(at[s]) - 2 * m)
                b = min(int(text_from[x + 1]), int(at[e - 1]) + 2 * m + p.size)
                score, begin, stop = smith_waterman(it.words[k], h[a:b], p)
                similarity = score / (p.match * m)
                if similarity >= p.similarity:
                    row_start = int(base[i + x])
                    yield i + x, k, similarity, int(start[a + begin]) - row_start, int(end[a + stop - 1]) - row_start, int(e - s)


def _aligned(items, p: Decontamination):
    @T.lean
    def run(batches):
        find = Aligner(items.value, p)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64()).to_pylist()
            found = [(docs[r], find.it.ids[k], v, x, y, len(find.it.words[k]), n, find.it.marks[k]) for r, k, v, x, y, n in find(batch.column(1))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            cols = list(zip(*found, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _HITS.split(", ")])

    return run


def _clean(items, p: Decontamination, text_at: int):
    @T.lean
    def run(batches):
        find = Aligner(items.value, p)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, *_ in find(batch.column(text_at)):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return run


def _seeded(texts: DataFrame, benchmark: DataFrame, p: Decontamination, item_col: str, item_text_col: str):
    """The seeds of each slice of the benchmark, shared with the tasks; texts has one column."""
    spark = texts.sparkSession
    side = benchmark.select(T.column(benchmark, item_col, "long").alias("item_id"), T.column(benchmark, item_text_col, "string").alias("text"))
    side = side.where("text is not null").distinct()
    chars = side.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-chars // p.slice_chars))
    most = max(p.spread_least, int(p.spread_share * texts.count()))
    for n in range(slices):
        rows = side.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in rows], [r[1] for r in rows], p.size)
        around = texts.mapInArrow(_surroundings(spark.sparkContext.broadcast(items)), "g long, around long")
        # one row per n-gram of the slice
        with T.small_batches(spark):
            spread = around.distinct().groupBy("g").agg(F.count("*").alias("n")).toPandas()
        yield spark.sparkContext.broadcast(items.seeds(spread["g"].to_numpy(np.int64), spread["n"].to_numpy(np.int64), most))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item it holds a copy of: doc_id, item_id, similarity
    of the best alignment, its byte range in the text, the item's words and seeds found.

    Similarity is the alignment score over that of a full copy. Null or empty texts on
    either side match nothing. Items of fewer words than a seed are found where all their words
    stand, unless these are as common in the corpus as no seed may be. Repeated rows are
    found as often as they occur but reported once per doc_id; a null doc_id is kept. Items
    with a null item_id count too: each different text of theirs is an item, reported with
    a null item_id.
    Other columns are ignored; empty tables give an empty result.
    """
    p = p or Decontamination()
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), T.column(docs, text_col, "string").alias("text"))
    found = [src.mapInArrow(_aligned(seeds, p), _HITS) for seeds in _seeded(src.select("text"), benchmark, p, item_col, item_text_col)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("doc_start")).alias("back"), "doc_end", "item_words", "seeds")).alias("b")
    out = out.groupBy("doc_id", "item_id", "mark").agg(best)
    return out.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("doc_start"), "b.doc_end", "b.item_words", "b.seeds")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no copy of a test item, with all their columns.

    Rows with a null or empty text stay; items with a null item_id count like others. The
    text column must be a string.
    """
    p = p or Decontamination()
    out = docs
    at = docs.columns.index(text_col)
    for seeds in _seeded(docs.select(T.column(docs, text_col, "string").alias("text")), benchmark, p, item_col, item_text_col):
        out = out.mapInArrow(_clean(seeds, p, at), docs.schema)
    return out
