"""The trie of conversations against one that is built conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from orrery.llm import ordered, prefixtrie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in said}
    return {c: said.get(c - c % 100, [])[: heads[c]] + v[heads[c] :] for c, v in said.items()}


def brute(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.add((min(members[p]), len(p), up, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same(frame, rows):
    got = [tuple(r) for r in prefixtrie.conversation_trie(frame).collect()]
    want = brute(rebuilt(rows)) if any(r[0] is not None for r in rows) else set()
    assert len(got) == len(want) and set(got) == want


def test_shared_starts(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(201, 225), 400, 500]:
        n = r.choice([1, 2, 3, 5, 6, 9, 14])
        rows += [(c, t, "ua"[t % 2], r.choice("xyz") * (1 + t)) for t in range(n)]
    # one conversation is far longer than the others, and many are the same
    rows += [(700, t, "user", "abc"[t % 3]) for t in range(75)]
    rows += [(c, t, "user", f"same {t}") for c in range(800, 860) for t in range(4)]
    same(spark.createDataFrame(rows, SCHEMA).repartition(6), rows)


def test_odd_rows(spark):
    """Nulls everywhere, ties, repeated rows, roles that run into texts, very long texts, conversations that lose all turns."""
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, None), (2, None, None, None),
        (2, None, None, None), (3, 5, "us", "er"), (3, 5, "user", ""), (4, 1, "user", "ü" * 50_000), (5, 1, "user", "ü" * 50_000), (5, 1, "user", "ü" * 50_000), (6, 0, "", "1:u"), (7, -3, "u", "1"),
        *((c, 0, "user", "gone") for c in range(101, 118)),
    ]
    frame = spark.createDataFrame([(*x, 1, "n", 2) for x in rows], SCHEMA + ", place int, name string, digest int")
    same(frame.repartition(3), rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(c, 0, "user", "gone") for c in (117, 105)]])
def test_few_rows(spark, rows):
    same(spark.createDataFrame(rows, SCHEMA), rows)


def test_names_are_dense(spark):
    rows = [(c, t + 1, f"{c % 3}{t}".encode(), 1) for c in range(9) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, place long, digest binary, chars long")
    names, _ = prefixtrie.prefix_names(frame, 6)
    got = names.groupBy("depth").agg(F.countDistinct("name").alias("n")).collect()
    assert {r.depth: r.n for r in got} == dict.fromkeys(range(1, 7), 3)
    assert names.agg(F.max("name")).first()[0] < 12  # two depths at most are named in a round of three


def test_running_sums_of_a_key_in_many_partitions(spark):
    rows = [(7, n, n % 5) for n in range(3000)] + [(k, 0, k) for k in range(30)]
    got = ordered.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(9), "k", [F.col("o")], F.col("v"), "s", ["o"]).collect()
    total, want = defaultdict(int), {}
    for k, o, v in sorted(rows):
        total[k] += v
        want[k, o, total[k]] = want.get((k, o, total[k]), 0) + 1
    # the two rows of key 7 that tie come in either order
    assert len(got) == len(rows) and {(r.k, r.o, r.s) for r in got if r.k != 7} == {x for x in want if x[0] != 7}
    assert sorted(r.s for r in got if r.k == 7)[-1] == total[7]


def test_hashes_over_many_rows(spark):
    rows = [(1, 2, v) for v in range(20_000)] + [(1, 3, -5), (1, 3, 4)]
    got = {(r.a, r.b): r.sha for r in ordered.joined_sha256(spark.createDataFrame(rows, "a long, b long, v long"), ("a", "b"), "v", "sha").collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"-5,4").hexdigest()}
