"""MinHash near-duplicates, verified by odd sketches and then on full shingle sets.

1. One scan hashes each text's word shingles and keeps a set digest, the MinHash
   samples folded into band keys, and an odd sketch: the samples folded into a parity
   bitmap. Texts with equal sets collapse to a class named by its least doc_id.
2. Classes that share a band key meet in that key's bucket. There the population count
   of the XOR of two odd sketches estimates their similarity; pairs well below the
   threshold fall out and each bucket hands on a spanning forest, never its pairs.
3. The forests' components are blocks of documents; whole texts of a block meet once
   and every pair in it is decided exactly by counting shared shingles.
4. Components of the exact links give the result.

Buckets and blocks have no cap: what exceeds a task's share is cut into pieces and
every pair of pieces meets in some task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T
from orrery.llm.graph import components


@dataclass(frozen=True)
class NearDup:
    """Links are pairs with 100 * intersection >= percent * union of their shingle sets.

    bands x rows MinHash samples: at a similarity of 0.8, 32 bands of 5 miss a pair with
    probability 3e-6. margin: standard deviations that a sketch may fall short.
    """

    size: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    sketch_words: int = 8
    margin: float = 5.0
    bucket_rows: int = 2048
    block_rows: int = 1024
    block_shingles: int = 500_000
    seed: int = 20177

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """The least estimate at which a pair is still looked at."""
        t = self.percent / 100
        return t - self.margin * (t * (1 - t) / self.samples) ** 0.5 - 0.01


def _sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    h, row, _, _ = T.words(data, off)
    s, r = T.shingles(h, row, size)
    cut = np.searchsorted(r, np.arange(len(off)))
    return [np.unique(s[cut[k] : cut[k + 1]]) for k in range(len(off) - 1)]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = T.utf8(column)
    return [u for i, j in T.pieces(off) for u in _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)]


_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def _features(p: NearDup):
    k, words = p.samples, p.sketch_words

    @T.lean
    def run(batches):
        rng = np.random.default_rng(p.seed)
        mul = rng.integers(1, 2**62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, k, dtype=np.uint64)
        salt = T.mix(np.arange(k, dtype=np.uint64) + np.uint64(p.seed))
        turn = T.mix(np.arange(p.bands, dtype=np.uint64) * np.uint64(977) + np.uint64(5))
        step = T.powers(p.rows)
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            for i, j in T.pieces(off):
                sets = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i], p.size)
                n = len(sets)
                low = np.zeros((n, k), np.uint64)
                d = np.zeros((n, 2), np.uint64)
                for x, u in enumerate(sets):
                    if len(u):
                        # a few samples at a time, as a set can be as long as the longest text
                        some = max(1, 4_000_000 // len(u))
                        for a in range(0, k, some):
                            low[x, a : a + some] = (u[None, :] * mul[a : a + some, None] + add[a : a + some, None]).min(axis=1)
                        d[x] = T.mix(u).sum(dtype=np.uint64), T.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                size = np.array([len(u) for u in sets], np.int64)
                keys = T.mix((T.mix(low).reshape(n, p.bands, p.rows) * step).sum(axis=2, dtype=np.uint64) + turn)
                at = (T.mix(low ^ salt) % np.uint64(64 * words)).astype(np.int64)
                odd = np.zeros((n, 64 * words), np.uint8)
                np.add.at(odd, (np.repeat(np.arange(n), k), at.ravel()), 1)
                sketch = np.packbits(odd & 1, axis=1, bitorder="little").view(np.uint64)
                full = size > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(size),
                        pa.array(T.i64(d[:, 0].copy())),
                        pa.array(T.i64(d[:, 1].copy())),
                        T.lists(T.i64(keys[full].ravel()), full * p.bands, pa.int64()),
                        T.lists(T.i64(sketch[full].ravel()), full * words, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return run


def estimate(xor_bits: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """The similarity that so many differing parity bits stand for."""
    share = np.minimum(2.0 * xor_bits / bits, 0.999)
    return 1.0 + bits / (4.0 * samples) * np.log1p(-share)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    out, todo = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if todo[root]:
            todo[root] = False
            stack = [root]
            while stack:
                x = stack.pop()
                got = np.flatnonzero(links[x] & todo)
                todo[got] = False
                out += [(x, int(y)) for y in got]
                stack += got.tolist()
    return out


def _gray(p: NearDup):
    """Spanning forests of the buckets' pairs whose sketches are near enough."""
    bits, floor = 64 * p.sketch_words, p.floor

    @T.lean
    def run(batches):
        for batch in T.by_group(batches, ["key", "pi", "pj"]):
            rep = batch.column("rep").to_numpy()
            sk = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, p.sketch_words)
            cuts = np.append(T.boundaries(batch, ["key", "pi", "pj"]), batch.num_rows)
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            x = np.bitwise_count(sk[two] ^ sk[two + 1]).sum(axis=1, dtype=np.int64)
            ok = estimate(x, bits, p.samples) >= floor
            a, b = [rep[two][ok]], [rep[two + 1][ok]]
            for s, m in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
                v = sk[s : s + m]
                near = np.empty((m, m), bool)
                for r in range(0, m, 64):
                    x = np.bitwise_count(v[r : r + 64, None, :] ^ v[None, :, :]).sum(axis=2, dtype=np.int64)
                    near[r : r + 64] = estimate(x, bits, p.samples) >= floor
                if tree := _forest(near):
                    f = np.array(tree)
                    a.append(rep[s + f[:, 0]])
                    b.append(rep[s + f[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])

    return run


def _linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among some sets."""
    m = len(sets)
    size = np.array([len(u) for u in sets], np.float64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) and size.all() else []
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size.astype(np.int64))
    keep = count[where] > 1
    name = np.cumsum(count > 1) - 1
    col, row = name[where[keep]], row[keep]
    width = int((count > 1).sum())
    both = np.zeros((m, m), np.float32)
    step = max(1, 16_000_000 // m)
    for c in range(0, width, step):
        part = (col >= c) & (col < c + step)
        dense = np.zeros((m, min(step, width - c)), np.float32)
        dense[row[part], col[part] - c] = 1
        both += dense @ dense.T
    both = both.astype(np.float64)
    links = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    links &= (size > 0)[:, None] & (size > 0)[None, :]
    return _forest(links)


def _exact(p: NearDup):
    @T.lean
    def run(batches):
        for batch in T.by_group(batches, ["block", "pi", "pj"]):
            rep = batch.column("rep").to_numpy()
            cuts = np.append(T.boundaries(batch, ["block", "pi", "pj"]), batch.num_rows)
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for x, y in _linked(shingle_sets(batch.column("text").slice(s, e - s), p.size), p.percent):
                    a.append(rep[s + x])
                    b.append(rep[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _paired(df: DataFrame, n_pieces: F.Column, by: F.Column) -> DataFrame:
    """Deal the rows of a group into pieces; each row goes to every pair of pieces with its own."""
    df = df.withColumn("_n", n_pieces).withColumn("_p", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    pairs = F.transform(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), lambda q: F.struct(F.least("_p", q).alias("i"), F.greatest("_p", q).alias("j")))
    pairs = F.when(F.col("_n") <= 1, alone).otherwise(pairs)
    return df.withColumn("_x", F.explode(pairs)).withColumn("pi", F.col("_x.i")).withColumn("pj", F.col("_x.j")).drop("_n", "_p", "_x")


def _blocks(reps: DataFrame, p: NearDup) -> DataFrame:
    """(rep, block): classes joined by pairs in a bucket whose sketches are near enough."""
    n = T.tasks(reps.sparkSession)
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = keys.join(shared, "key").join(reps.select("rep", "sketch"), "rep")
    buckets = _paired(buckets, F.ceil(F.col("n") / p.bucket_rows), F.col("rep"))
    dealt = buckets.select("key", "pi", "pj", "rep", "sketch").repartition(n, "key", "pi", "pj").sortWithinPartitions("key", "pi", "pj")
    gray = dealt.mapInArrow(_gray(p), "a long, b long")
    return T.saved(components(gray, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("block")))


def near_duplicates(docs: DataFrame, p: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links, the row's own included; kept
    says whether it is the row's own. Null and empty texts, and texts of white space
    only, have an empty set, are linked with nothing and are their own component. Rows
    with the same doc_id count as one document; a null doc_id takes no part in links
    (component_id null, kept true). Texts of fewer words than a shingle are one shingle.
    Other columns are ignored. An empty table gives an empty result.
    """
    p = p or NearDup()
    spark = docs.sparkSession
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), T.column(docs, text_col, "string").alias("text"))
    rows = T.saved(src.mapInArrow(_features(p), _FEATURES))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = T.saved(some.join(classes, ["d1", "d2"]).where("doc_id = rep").select("rep", "n_shingles", "bands", "sketch"))

    blocks = _blocks(reps, p)
    # the buckets' shuffles are larger than those of the texts to come
    T.release(spark)
    sized = blocks.join(reps.select("rep", "n_shingles").distinct(), "rep")
    shares = sized.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / p.block_rows), F.ceil(F.sum("n_shingles") / p.block_shingles)).alias("pieces"))
    members = blocks.join(shares, "block")
    texts = src.join(members, F.col("doc_id") == F.col("rep")).drop("doc_id")
    texts = _paired(texts, F.col("pieces"), F.col("rep"))
    dealt = texts.select("block", "pi", "pj", "rep", "text").repartition(T.tasks(spark), "block", "pi", "pj").sortWithinPartitions("block", "pi", "pj")
    links = dealt.mapInArrow(_exact(p), "a long, b long")

    named = components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component"))
    known = some.join(classes, ["d1", "d2"]).select("doc_id", "rep").union(reps.select(F.col("rep").alias("doc_id"), "rep"))
    of = known.join(named, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
