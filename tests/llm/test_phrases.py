"""Passage removal against a plain comparison of all windows of words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import phrases
from tests.llm.conftest import prose


def brute(rows, n):
    words = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    seen = Counter(tuple(w[i : i + n]) for _, w in words for i in range(len(w) - n + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        edges = [i for i in range(len(w) + 1) if (i < len(w) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, tuple(zip(edges[::2], edges[1::2], strict=True))))
    return Counter(out)


def found(docs, p):
    got = phrases.remove_passages(docs, p, texts=True).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept, tuple((s.start, s.end) for s in r.spans)) for r in got)


def shared_rows():
    r = random.Random(11)
    passages = [prose(100 + n, 30) for n in range(6)]
    rows = []
    for n in range(120):
        parts = [prose(1000 + n, r.randint(3, 40)) for _ in range(3)]
        if n % 2:
            # passages in part or in whole, set apart by other white space
            w = r.choice(passages).split()
            a = r.randint(0, 8)
            parts.insert(r.randint(0, 3), r.choice([" ", "\n", "\t\v "]).join(w[a : a + r.randint(6, 30)]))
        if n % 10 == 0:
            parts += parts[:1]  # twice in one text
        rows.append((n, "  ".join(parts)))
    base = prose(7, 60).split()
    for n in range(60):  # near copies
        w = list(base)
        w[r.randrange(60)] = f"edit{n % 7}"
        rows.append((500 + n, " ".join(w)))
    rows += [(700 + n, " \n".join(base)) for n in range(5)] + [(900, "Case " + prose(100, 30).upper())]
    return rows


SMALL = dict(words=9, gram=3)


def test_odd_texts(odd_docs, odd_rows):
    assert found(odd_docs, phrases.Phrases(**SMALL)) == brute(odd_rows, 9)


@pytest.mark.parametrize("p", [{}, {"piece_rows": 3}, {"automaton_rows": 1}, {"gram": 9}, {"gram": 1}])
def test_shared_passages(spark, p):
    rows = shared_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, phrases.Phrases(**{**SMALL, **p})) == brute(rows, 9)


def test_automata_decide(monkeypatch):
    """Without what the automata find, a shard removes nothing."""
    text = prose(5, 20)
    raw = [text.encode(), f"before {text}".encode(), prose(6, 20).encode()]
    cols = [pa.array(x, t) for x, t in (([1, 2, 3], pa.int64()), ([0, 0, 0], pa.int64()), ([7, 7, 8], pa.int64()), ([0, 0, 0], pa.int32()), ([4, 5, 0], pa.int32()), ([12, 13, 12], pa.int32()), (raw, pa.binary()))]
    rows = pa.RecordBatch.from_arrays(cols, ["doc", "th", "gram", "piece", "s1", "windows", "raw"])
    some = lambda: [(r["doc"], r["a"], r["b"]) for batch in phrases._located(rows, phrases.Phrases(**SMALL)) for r in batch.to_pylist()]
    assert some() == [(1, 4, 24), (2, 6, 26)]
    monkeypatch.setattr(phrases, "occurrences", lambda symbols, shard, passages: np.zeros(len(symbols), bool))
    assert some() == []


def test_occurrences():
    # two shards: what a shard does not know it does not find
    text = np.array([1, 2, 3, 0, 9, 1, 2, 3, 1, 2, 3, 0, 0xD7FF, 0xD800, 0xE000, 0, 1, 2, 3, 0xD7FF, 0xD800, 0])
    shard = np.repeat([0, 1], [16, 6])
    got = phrases.occurrences(text, shard, [(0, 3), (12, 14), (19, 21)])
    assert np.flatnonzero(got).tolist() == [0, 1, 2, 5, 6, 7, 8, 9, 10, 12, 13, 19, 20]


def test_no_rows(no_docs):
    assert phrases.remove_passages(no_docs, texts=True).count() == 0


def test_windows_have_a_limit():
    with pytest.raises(ValueError):
        phrases.Phrases(words=128)
