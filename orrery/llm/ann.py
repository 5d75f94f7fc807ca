"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids are fitted on a bounded sample and balanced: lists far over the mean size take
over the centroids of the smallest. Their number grows with the rows, up to ``max_lists``.
More than ``top_lists`` are fitted in two levels: the driver divides a small sample into a
few hundred regions, and tasks divide the sample of each region. Every vector goes to its nearest list and, if it
lies near a boundary, to further ones whose centroids are hardly farther (up to
``copies``). A query reads the lists whose centroid is at most so many times as far as
the nearest one. Both find centroids by best-first search in a neighbour graph that each
task holds; it has at most ``max_lists`` nodes, so beyond max_lists * list_rows rows it is
the lists that grow. A query that would
read every list its search found looks at all centroids, so the search bounds nothing.

How far a query reads is measured on the table at hand: a bounded sample of queries is
compared with all rows, and the ratio is the one at which ``recall`` of their true
neighbours stand in a list that is read, and ``probe_ratio`` at least.

Inner products become distances by one more dimension, sqrt(M**2 - |x|**2) with M the
largest norm, and by scaling queries to M. Lists longer than a block are read in blocks,
so a vector that a third of all rows share, or a crowded region, spreads over tasks.
Only the best of each query and block travel on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import textops as T


@dataclass(frozen=True)
class Ann:
    """top: neighbours of each query. list_rows: mean size of a list aimed at; max_lists: most
    lists. fit_rows bounds the sample (the rows with the least hash of their id) for lists
    up to top_lists or for the regions of more; then a region has another sample of fit_rows
    rows at most, 16 for each list in the mean.
    probe_ratio: the least ratio of distances within which lists are read; recall: share of
    the true neighbours of probe_queries queries that the ratio in use must reach.
    query_beam: width of a query's search before all centroids are looked at."""

    top: int = 20
    fit_rows: int = 65_536
    list_rows: int = 256
    max_lists: int = 65_536
    top_lists: int = 4096
    copies: int = 4
    copy_ratio: float = 1.06
    probe_ratio: float = 1.14
    recall: float = 0.99
    probe_queries: int = 256
    degree: int = 16
    beam: int = 48
    query_beam: int = 192
    block_rows: int = 4096
    iterations: int = 8
    seed: int = 20408


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector, and the vectors as doubles.

    Usable: not null, of ``dims`` numbers, finite, and not all zero.
    """
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(0)) == dims)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], x[ok]


def near_centroids(c: np.ndarray, of: np.ndarray, degree: int) -> np.ndarray:
    """The nearest other centroids of some."""
    n = min(degree, len(c) - 1)
    if n < 1:
        return np.zeros((len(of), 1), np.int64)
    d = (c**2).sum(axis=1)[None, :] - 2 * c[of] @ c.T
    d[np.arange(len(of)), of] = np.inf
    return np.argpartition(d, n - 1, axis=1)[:, :n]


class Graph:
    """Centroids and a navigable graph of their neighbours, which may be given."""

    def __init__(self, centroids: np.ndarray, degree: int, near: np.ndarray | None = None):
        self.c = centroids
        self.norm = (centroids**2).sum(axis=1)
        k = len(centroids)
        if near is None:
            near = np.concatenate([near_centroids(centroids, np.arange(i, min(i + 256, k)), degree) for i in range(0, k, 256)])
        links = [set(map(int, r)) for r in near]
        for a, r in enumerate(near):
            for b in r:
                links[int(b)].add(a)
        rng = np.random.default_rng(k)
        # a few far links keep the graph connected
        for a in range(k):
            links[a].update(map(int, rng.integers(0, k, 4)))
        width = max(map(len, links))
        self.links = np.array([sorted(s) + [a] * (width - len(s)) for a, s in enumerate(links)], np.int64)
        self.entry = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each row, nearest first, and their distances."""
        m, k = len(q), len(self.c)
        beam = min(beam, k)
        qn = (q**2).sum(axis=1)
        rows = np.arange(m)[:, None]

        def distance(ids):
            return np.maximum(qn[:, None] + self.norm[ids] - 2 * np.einsum("md,mnd->mn", q, self.c[ids]), 0)

        seen = np.zeros((m, k), bool)
        ids = np.broadcast_to(self.entry, (m, len(self.entry)))
        seen[:, self.entry] = True
        d = distance(ids)
        opened = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, opened = ids[rows, order], d[rows, order], opened[rows, order]
            todo = np.where(opened, np.inf, d)
            pick = np.argsort(todo, axis=1, kind="stable")[:, :4]
            live = np.isfinite(todo[rows, pick])
            if not live.any():
                break
            opened[rows, pick] = True
            new = self.links[ids[rows, pick]].reshape(m, -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.links.shape[1], axis=1)
            # the same centroid may come from two of the opened ones
            order = np.argsort(new, axis=1, kind="stable")
            same = np.zeros(new.shape, bool)
            s = new[rows, order]
            same[rows, order[:, 1:]] = s[:, 1:] == s[:, :-1]
            fresh &= ~same
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            got = np.where(fresh, distance(new), np.inf)
            ids, d = np.concatenate((ids, new), axis=1), np.concatenate((d, got), axis=1)
            opened = np.concatenate((opened, ~fresh), axis=1)
        return ids, np.sqrt(d)

    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids for each row, nearest first, and their distances."""
        d = np.maximum((q**2).sum(axis=1)[:, None] + self.norm - 2 * q @ self.c.T, 0)
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.sqrt(np.take_along_axis(d, ids, axis=1))


def balanced_centroids(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """k-means in which the smallest clusters are given up to divide those of over twice the mean size."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for n in range(iterations):
        own = np.concatenate([((x[i : i + 8192] @ c.T) - 0.5 * (c**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(x), 8192)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        if n < iterations - 2:
            large = [j for j in np.argsort(-size) if size[j] > 2 * len(x) / k]
            for j, small in zip(large, np.argsort(size), strict=False):
                if size[small] < 0.5 * len(x) / k:
                    c[small] = x[rng.choice(np.flatnonzero(own == j))]
    return c


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(top**2 - (x**2).sum(axis=1, keepdims=True), 0))), axis=1)


def _valid(dims: int):
    @T.lean
    def run(batches):
        for batch in batches:
            rows, x = matrix(batch.column(1), dims)
            ids = batch.column(0).cast(pa.int64()).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, T.lists(x.ravel(), np.full(len(rows), dims), pa.float64()), pa.array((x**2).sum(axis=1))], ["id", "v", "norm2"])

    return run


def _regional(rows: DataFrame, regions: np.ndarray, k: int, top: float, p: Ann) -> np.ndarray:
    """About k centroids: the sample of each region is divided in a task of its own."""
    spark = rows.sparkSession
    n = rows.count()
    take = 16 * k
    shared = spark.sparkContext.broadcast(regions)

    @T.lean
    def placed(batches):
        c = shared.value
        half = 0.5 * (c**2).sum(axis=1)
        for batch in batches:
            x = _augmented(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1), top)
            own = np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("id"), batch.column("v")], ["region", "id", "v"])

    def divided(pdf):
        import pandas as pd

        x = _augmented(np.unique(np.stack(pdf["v"].to_numpy()), axis=0), top)
        own = max(1, min(p.top_lists, round(len(pdf) / 16), len(x) // 4))
        c = balanced_centroids(x, own, p.iterations, p.seed)
        return pd.DataFrame({"c": list(c)})

    some = rows.select("id", "v").where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, take / n)))
    each = some.mapInArrow(placed, "region long, id long, v array<double>")
    # what a region has over fit_rows rows is left out of its sample by hash
    size = each.groupBy("region").agg(F.count("*").alias("n"))
    each = each.join(F.broadcast(size), "region").where(F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.lit(1 << 30)) * F.col("n") < F.lit(p.fit_rows << 30))
    found = each.groupBy("region").applyInPandas(divided, "c array<double>").toPandas()
    return np.stack(found["c"].to_numpy())


def fitted(rows: DataFrame, n: int, top: float, p: Ann) -> Graph:
    """The centroids and their graph, for n rows."""
    spark = rows.sparkSession
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(p.fit_rows).toPandas()
    sample = _augmented(np.unique(np.stack(drawn["v"].to_numpy()), axis=0), top)
    k = max(1, min(p.max_lists, n // p.list_rows))
    if k <= p.top_lists:
        return Graph(balanced_centroids(sample, max(1, min(k, len(sample) // 16)), p.iterations, p.seed), p.degree)
    regions = balanced_centroids(sample, max(1, min(int(k**0.5), len(sample) // 16)), p.iterations, p.seed)
    c = _regional(rows, regions, k, top, p)
    shared = spark.sparkContext.broadcast(c)

    @T.lean
    def near(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                of = batch.column(0).to_numpy()[i : i + 256]
                found = near_centroids(shared.value, of, p.degree)
                yield pa.RecordBatch.from_arrays([pa.array(of), T.lists(found.ravel(), np.full(len(of), found.shape[1]), pa.int64())], ["id", "near"])

    links = spark.range(0, len(c), 1, T.tasks(spark)).mapInArrow(near, "id long, near array<long>").orderBy("id").toPandas()
    return Graph(c, p.degree, np.stack(links["near"].to_numpy()))


def _scaled(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x * (top / np.sqrt((x**2).sum(axis=1, keepdims=True))), np.zeros((len(x), 1))), axis=1)


def _unasked(sizes: np.ndarray, ids: np.ndarray, p: Ann) -> np.ndarray:
    """Lists read in any case: as many as hold enough rows."""
    return np.cumsum(sizes[ids], axis=1) - sizes[ids] < 2 * p.top * p.copies


def lists_read(graph: Graph, a: np.ndarray, sizes: np.ndarray, ratio: float, least: float, p: Ann) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of each list that a query reads; distances under ``least`` count as that."""

    def taken(ids, d):
        return (d <= ratio * np.maximum(d[:, :1], least) + 1e-12) | _unasked(sizes, ids, p)

    ids, d = graph.search(a, p.query_beam)
    take = taken(ids, d)
    # the search ended before the ratio did
    more = np.flatnonzero(take[:, -1]) if ids.shape[1] < len(graph.c) else np.zeros(0, np.int64)
    take[more] = False
    r, c = np.nonzero(take)
    lists = ids[r, c]
    if len(more):
        ids, d = graph.all(a[more])
        s, c = np.nonzero(taken(ids, d))
        r, lists = np.concatenate((r, more[s])), np.concatenate((lists, ids[s, c]))
    return r, lists


def _to_lists(shared, p: Ann, query: bool):
    """Rows of a vector for each of its posting lists, or of a query for each list it reads."""

    @T.lean
    def run(batches):
        graph, top, sizes, ratio, least = shared.value
        for whole in batches:
            # a search marks the centroids that each of its rows has seen
            step = max(64, min(1024, (1 << 24) // len(graph.c)))
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                if query:
                    r, lists = lists_read(graph, _scaled(x, top), sizes, ratio, least, p)
                else:
                    ids, d = graph.search(_augmented(x, top), p.beam)
                    r, c = np.nonzero(d[:, : p.copies] <= p.copy_ratio * d[:, :1] + 1e-12)
                    lists = ids[r, c]
                for i in range(0, len(r), 32_768):
                    at = pa.array(r[i : i + 32_768])
                    yield pa.RecordBatch.from_arrays([pa.array(lists[i : i + 32_768]), batch.column("id").take(at), batch.column("v").take(at)], ["list", "id", "v"])

    return run


def _best(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, score: np.ndarray, top: int):
    """The nearest of a block by exact score, ties to the smaller id."""
    free = ids != own
    n = int(free.sum())
    if n == 0:
        return ids[:0], np.zeros(0)
    s = np.where(free, score, -np.inf)
    k = min(top, n)
    cut = np.partition(s, len(s) - k)[len(s) - k]
    at = np.flatnonzero(s >= cut - 1e-9 * (1 + abs(cut)))
    # one order of summation for every row, so equal vectors have equal scores
    exact = np.einsum("ij,j->i", rows[at], q)
    order = np.lexsort((ids[at], -exact))
    at, exact = at[order], exact[order]
    _, first = np.unique(ids[at], return_index=True)
    first = np.sort(first)[:top]
    return ids[at[first]], exact[first]


def _exact(shared, p: Ann):
    """The nearest rows of each sampled query in a partition, by all of its rows."""

    @T.lean
    def run(batches):
        own, q = shared.value
        ids, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                new = np.broadcast_to(batch.column("id").to_numpy(), (len(q), batch.num_rows))
                got = q @ batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).T
                ids = np.concatenate((ids, new), axis=1)
                score = np.concatenate((score, np.where(new == own[:, None], -np.inf, got)), axis=1)
                if ids.shape[1] > p.top:
                    best = np.argpartition(-score, p.top - 1, axis=1)[:, : p.top]
                    ids, score = np.take_along_axis(ids, best, axis=1), np.take_along_axis(score, best, axis=1)
        r, c = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(ids[r, c]), pa.array(score[r, c])], ["q", "id", "score"])

    return run


def measured_ratio(rows: DataFrame, postings: DataFrame, asked: DataFrame, graph: Graph, top: float, sizes: np.ndarray, p: Ann) -> tuple[float, float]:
    """The ratio within which lists are read, and the distance that nearer centroids count as.

    The true neighbours of the sampled queries are found among all rows. One is reached at
    the ratio of the nearest list that holds it.
    """
    drawn = asked.orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(p.probe_queries).toPandas()
    if len(sizes) == 1 or len(drawn) == 0:
        return p.probe_ratio, 0.0
    x = np.stack(drawn["v"].to_numpy())
    ahead = [graph.all(_scaled(q[None], top)) for q in x]
    least = 0.25 * float(np.median([d[0, 0] for _, d in ahead]))
    by_list = np.empty((len(x), len(sizes)), np.float32)
    for n, (ids, d) in enumerate(ahead):
        reach = np.where(_unasked(sizes, ids, p), 1.0, d / np.maximum(np.maximum(d[:, :1], least), 1e-12))
        # rounded up, so that the ratio reaches what it is measured on
        by_list[n, ids[0]] = np.nextafter(reach[0].astype(np.float32), np.float32(np.inf))
    shared = rows.sparkSession.sparkContext.broadcast((drawn["id"].to_numpy(), x))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = rows.select("id", "v").mapInArrow(_exact(shared, p), "q long, id long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.top).select("q", "id").distinct()
    # the lists of a few thousand rows
    at = postings.select("list", "id").join(F.broadcast(true), "id").distinct().toPandas()
    if len(at) == 0:
        return p.probe_ratio, least
    at["reach"] = by_list[at["q"].to_numpy(), at["list"].to_numpy()]
    needed = np.sort(at.groupby(["q", "id"])["reach"].min().to_numpy())
    return max(p.probe_ratio, float(needed[int(np.ceil(p.recall * len(needed))) - 1])), least


def _scan(p: Ann):
    """Best rows of each query in each block; a block's rows come before its queries."""

    @T.lean
    def run(batches):
        key, rows, ids, parts = None, None, None, []
        for batch in batches:
            cuts = np.append(T.boundaries(batch, ["list", "block", "kind"]), batch.num_rows)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(s, e - s)
                now = (part.column("list")[0].as_py(), part.column("block")[0].as_py())
                x = part.column("v").flatten().to_numpy().reshape(e - s, -1)
                if now != key:
                    key, rows, parts = now, None, []
                if part.column("kind")[0].as_py() == 0:
                    parts.append((x, part.column("id").to_numpy()))
                    rows = None
                    continue
                if not parts:
                    continue
                if rows is None:
                    rows, ids = (np.concatenate(z) for z in zip(*parts, strict=True))
                q = part.column("id").to_numpy()
                for i in range(0, len(q), 256):
                    score = x[i : i + 256] @ rows.T
                    got = [_best(rows, ids, x[i + n], int(q[i + n]), score[n], p.top) for n in range(len(score))]
                    lens = [len(g[0]) for g in got]
                    flat = [np.concatenate(z) for z in zip(*got, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 256]), T.lists(flat[0], lens, pa.int64()), T.lists(flat[1], lens, pa.float64())], ["q", "ids", "scores"])

    return run


def _merge(p: Ann):
    @T.lean
    def run(batches):
        for batch in T.by_group(batches, ["q"]):
            q = batch.column("q").to_numpy()
            n = np.diff(batch.column("ids").offsets.to_numpy())
            ids, score = batch.column("ids").flatten().to_numpy(), batch.column("scores").flatten().to_numpy()
            of = np.repeat(q, n)
            order = np.lexsort((ids, -score, of))
            of, ids, score = of[order], ids[order], score[order]
            # copies of a row from other lists have the same score and stand beside it
            keep = np.ones(len(of), bool)
            keep[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
            of, ids, score = of[keep], ids[keep], score[keep]
            rank = np.arange(len(of)) - np.searchsorted(of, of) + 1
            top = rank <= p.top
            yield pa.RecordBatch.from_arrays([pa.array(of[top]), pa.array(rank[top].astype(np.int32)), pa.array(ids[top]), pa.array(score[top])], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, p: Ann | None = None, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows of each row whose id is divisible by ``every``.

    score is the inner product of the original vectors in double precision; ties go to
    the smaller id. Rows with a null id, and vectors that are null, zero, or hold null or
    non-finite components take no part. All vectors of a table have one length, for
    vectors of different lengths have no inner product: the one that most of its rows
    have (of equally many the smaller); vectors of another length take no part. Rows that
    share an id count as one row per distinct vector and are never each other's
    neighbours; the least of their vectors is the query. Other columns are ignored; an
    empty table gives an empty result.
    """
    p = p or Ann()
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    src = vectors.select(T.column(vectors, id_col, "long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null")
    lengths = src.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    rows = T.stored(src.mapInArrow(_valid(lengths.dims), "id long, v array<double>, norm2 double"))
    n, top2 = rows.agg(F.count("*"), F.max("norm2")).first()
    if not n:
        return spark.createDataFrame([], out_schema)
    top = float(top2) ** 0.5
    graph = fitted(rows, n, top, p)
    k = len(graph.c)
    shared = spark.sparkContext.broadcast((graph, top, None, None, None))
    kind = "list long, id long, v array<double>"
    postings = T.stored(rows.select("id", "v").mapInArrow(_to_lists(shared, p, False), kind))
    counted = T.stored(postings.groupBy("list").agg(F.count("*").alias("n")))
    # one number per list
    sizes = np.zeros(k, np.int64)
    for r in counted.collect():
        sizes[r[0]] = r[1]
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    shared = spark.sparkContext.broadcast((graph, top, sizes, *measured_ratio(rows, postings, asked, graph, top, sizes, p)))
    queries = asked.mapInArrow(_to_lists(shared, p, True), kind)
    blocks = F.broadcast(counted.select("list", F.ceil(F.col("n") / p.block_rows).cast("int").alias("blocks")))
    held = postings.join(blocks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    read = queries.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = held.unionByName(read).repartition(T.tasks(spark), "list", "block").sortWithinPartitions("list", "block", "kind")
    found = dealt.mapInArrow(_scan(p), "q long, ids array<long>, scores array<double>")
    dealt = found.repartition(T.tasks(spark), "q").sortWithinPartitions("q")
    return dealt.mapInArrow(_merge(p), out_schema)
