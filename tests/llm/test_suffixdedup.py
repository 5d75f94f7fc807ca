"""Repeat removal against a plain comparison of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import suffixdedup
from tests.llm.conftest import prose


def brute(rows, n):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return Counter(out)


def same(docs, rows, p):
    got = suffixdedup.remove_repeats(docs, p, texts=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) for r in got) == brute(rows, p.length)


SMALL = dict(length=60, gram=12, reach=20)


def test_odd_texts(odd_docs, odd_rows):
    same(odd_docs, odd_rows, suffixdedup.Repeats(**SMALL))


@pytest.mark.parametrize("pieces", [8192, 3])
def test_shared_passages(spark, pieces):
    rows = shared_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(docs, rows, suffixdedup.Repeats(**SMALL, piece_rows=pieces, bloom_bits=1 << 12))


def test_doubling_decides(spark, monkeypatch):
    """Each half of a window repeats, and no window does."""
    first = [prose(n, 30)[:60] for n in range(4)]
    rows = [(4 * n + m, f"{x}{prose(8, 2)}{c * 3}{prose(9, 30)[:60]}") for n, x in enumerate(first) for m, c in enumerate("QXYZ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = suffixdedup.Repeats(length=100, gram=8, reach=12)
    same(docs, rows, p)
    right = {tuple(r) for r in suffixdedup.remove_repeats(docs, p).collect()}
    paired = suffixdedup._paired
    # without the second rank of a pair, the rank of the first half stands for the whole run
    monkeypatch.setattr(suffixdedup, "_paired", lambda x, *a: paired(x, *a).withColumn("r_b", F.lit(0).cast("long")))
    assert {tuple(r) for r in suffixdedup.remove_repeats(docs, p).collect()} != right


def test_ranks(spark):
    """Ranks follow the sorted values and hold across partitions, also for a value that fills several."""
    r = random.Random(3)
    rows = [(d, 0, r.choice([5, 5, 5, 5, r.randrange(40)]), r.randrange(2)) for d in range(600)] + [(1000, 0, 99, 0)]
    x = spark.createDataFrame(rows, "doc long, i int, u long, w int").repartition(5)
    got, _ = suffixdedup.ranked(x, ("u", "w"), 50)
    of = {d: (u, w) for d, _, u, w in rows}
    seen = Counter(of.values())
    ranks = {}
    found = got.collect()
    for row in found:
        ranks.setdefault(of[row.doc], set()).add(row.r)
    assert all(len(x) == 1 for x in ranks.values())
    assert [min(ranks[v]) for v in sorted(ranks)] == sorted(min(x) for x in ranks.values()) and len({min(x) for x in ranks.values()}) == len(ranks)
    assert {d for d, v in of.items() if seen[v] > 1} <= {row.doc for row in found}
    pieces = Counter((of[row.doc], row.piece) for row in found)
    assert max(pieces.values()) <= 50 and all(row.many for row in found if seen[of[row.doc]] > 50)
    assert all(len({row.piece for row in found if of[row.doc] == v}) == 1 for v in {of[row.doc] for row in found if not row.many})


def shared_rows():
    r = random.Random(11)
    pool = [prose(900 + k, n) for k, n in enumerate((6, 9, 10, 12, 14, 30))]
    rows = []
    for d in range(60):
        parts = [prose(d, r.randrange(3, 40))]
        for _ in range(r.randrange(4)):
            x = r.choice(pool)
            a = r.randrange(len(x) // 2)
            parts += [x[a : a + r.randrange(30, 120)], prose(1000 + d, 5)]
        rows.append((d, ("é" * (d % 3)) + "".join(parts)))
    rows += [(100, "ab" * 200), (101, "ab" * 100), (102, "z" * 59), (103, "z" * 60), (104, "y" * 61)]
    return rows


def test_empty_table(no_docs):
    assert suffixdedup.remove_repeats(no_docs).count() == 0
