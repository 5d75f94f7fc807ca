"""Near-duplicates against all pairs."""

import itertools
import random

import pytest

from orrery.llm import neardup
from orrery.llm.graph import components
from tests.llm.conftest import prose


def brute(rows, size, percent):
    """doc_id -> (sizes of its texts' sets, component)."""
    sets, up = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(s)
        up[d] = d

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, sa), (b, sb) in itertools.combinations([(d, s) for d, ss in sets.items() if d is not None for s in ss if s], 2):
        both = len(sa & sb)
        if 100 * both >= percent * (len(sa) + len(sb) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: find(d) for d in up if d is not None}, sets


def same(docs, rows, p):
    got = neardup.near_duplicates(docs, p).collect()
    comp, sets = brute(rows, p.size, p.percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == comp[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize("size", [2, 5])
def test_odd_texts(odd_docs, odd_rows, size):
    same(odd_docs, odd_rows, neardup.NearDup(size=size))


def test_edited_copies_around_the_threshold(spark):
    r = random.Random(5)
    rows = []
    for base in range(4):
        words = prose(base, 150).split()
        for k in range(60):
            w = list(words)
            for _ in range(r.randrange(0, 22)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((base * 100 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(docs, rows, neardup.NearDup(size=2))
    # small pieces: every bucket and block is cut
    same(docs, rows, neardup.NearDup(size=2, bucket_rows=7, block_rows=5, block_shingles=2000))


def test_empty_table(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    comp = {}
    for a, b in edges:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {n: c for n, c in comp.items() if n != 500}
