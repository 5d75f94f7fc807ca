"""Nearest neighbours against all pairs."""

import numpy as np
import pytest

from orrery.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id long, v string, list int"


def exact(x, ids, q, top):
    s = np.array([np.einsum("j,j->", a, x[q]) for a in x])
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(s[i])) for i in order[:top]]


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    x = (centers[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, v.tolist(), 1, "a", 2) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = {}
    for r in ann.nearest(docs, ann.Ann(list_rows=100, block_rows=64), every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 150
    xd, hit = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        want = exact(xd, np.arange(3000), q, 20)
        hit += len({f[1] for f in found} & {w[0] for w in want})
        for _, v, s in found:
            assert v != q and abs(s - float(xd[v] @ xd[q])) < 1e-12
    assert hit / (150 * 20) >= 0.9


def test_odd_vectors_ties_and_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [2.0, 0.5]), (40, [2.0, 0.5])]
    docs = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA).repartition(2)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(docs, every=20).collect())
    assert got == [(0, 1, 40, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 3, 0.0), (40, 1, 0, 2.0), (40, 2, 1, 2.0), (40, 3, 2, 2.0), (40, 4, 3, 0.5)]
    assert ann.nearest(docs.where("vec_id < 0"), every=20).count() == 0
    assert ann.nearest(docs.where("vec_id = 4 or vec_id = 5"), every=20).count() == 0


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    docs = spark.createDataFrame([(i, v.tolist(), 1, "a", 2) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = [r.vec_id for r in ann.nearest(docs, ann.Ann(block_rows=50, list_rows=50), every=900).orderBy("rank").collect()]
    assert got[:1] != [] and set(got) == {int(v) for v, _ in exact(x.astype(float), np.arange(900), 0, 20)}


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(500, 12))
    g = ann.Graph(c, 16)
    q = rng.normal(size=(300, 12))
    ids, d = g.search(q, 32)
    best = ((q[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (ids[:, 0] == best).mean() > 0.97
    assert (np.diff(d, axis=1) >= -1e-9).all()


def test_the_beam_bounds_no_query():
    """A query reads every list within the ratio, however narrow its search began."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(600, 12))
    g = ann.Graph(c, 16)
    q = rng.normal(size=(40, 12))
    d = np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(axis=2))
    r, lists = ann.lists_read(g, q, np.full(600, 256), 1.5, 0.0, ann.Ann(query_beam=24))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 1.5 * d.min(axis=1, keepdims=True)), strict=True)}
    assert len(want) > 40 * 24 and want <= set(zip(r.tolist(), lists.tolist(), strict=True))
    assert len(set(zip(r.tolist(), lists.tolist(), strict=True))) == len(r)


def test_recall_of_vectors_spread_evenly(spark):
    """Short lists and many of them, so that neither the beam nor the least ratio reaches far enough."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, v.tolist(), 1, "a", 2) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = {}
    for r in ann.nearest(docs, ann.Ann(list_rows=16, query_beam=32), every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {w[0] for w in exact(x.astype(float), np.arange(6000), q, 20)}) for q in got)
    assert len(got) == 300 and hit / (300 * 20) >= 0.97


@pytest.mark.parametrize("even", [True, False])
def test_recall_of_lists_fitted_in_two_levels(spark, even):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 16)) if even else rng.normal(size=(30, 16))[rng.integers(0, 30, 5000)] + 0.3 * rng.normal(size=(5000, 16))
    x[:1700] = np.where(rng.random(1700)[:, None] < 0.5, x[0], x[:1700])
    x = x.astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist(), 1, "a", 2) for i, v in enumerate(x)], SCHEMA).repartition(4)
    p = ann.Ann(list_rows=32, top_lists=50, fit_rows=1000)
    rows = docs.select("vec_id", "embedding").withColumnsRenamed({"vec_id": "id", "embedding": "v"}).selectExpr("id", "cast(v AS array<double>) AS v")
    assert len(ann.fitted(rows, 5000, float((x.astype(float) ** 2).sum(axis=1).max() ** 0.5), p).c) > 60
    got = {}
    for r in ann.nearest(docs, p, every=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    want = {q: [s for _, s in exact(x.astype(float), np.arange(5000), q, 20)] for q in got}
    hit = sum(s >= want[q][-1] - 1e-12 for q, found in got.items() for _, s in found)
    assert len(got) == 125 and hit / (125 * 20) >= 0.95


def test_one_length_for_the_whole_table(spark):
    """300 vectors of 8 numbers and 100 of 6, in batches that hold either or both."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i < 300 else 6).tolist()) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (100, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
            got = ann.nearest(docs, every=20).collect()
            assert {r.query_id for r in got} == set(range(0, 300, 20)) and all(r.vec_id < 300 for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
