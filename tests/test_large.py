"""What only larger tables show: long serial numbers, crowds, dense clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.operators import spatial as S
from orrery.operators.components import close_components, components
from orrery.sources import datasource, pockets, sinks, structures, tables

SERIALS = [1, 99_999, 100_000, 123_456, 43_770_015, 43_770_016, 87_440_031]


def test_serial_numbers_keep_their_columns(spark):
    n = spark.createDataFrame([(s,) for s in SERIALS], "serial int")
    field = structures.serial_field(F.col("serial"))
    got = n.select("serial", field.alias("f"), structures.serial_number(field).alias("back")).orderBy("serial").collect()
    assert [r.f for r in got] == ["    1", "99999", "A0000", "A0I3K", "ZZZZZ", "a0000", "zzzzz"]
    assert [r.back for r in got] == SERIALS
    assert [structures.serial_of(r.f.strip()) for r in got] == SERIALS
    atoms = n.select(F.lit("a").alias("item"), "serial", F.lit("CA").alias("name"), F.lit(None).cast("string").alias("altloc"), F.lit("ALA").alias("res_name"), F.lit("A").alias("chain_id"), F.lit(7).alias("seq_num"),
                     F.lit(None).cast("string").alias("ins_code"), *(F.lit(v).alias(c) for v, c in zip((1.5, -2.5, 3.5), "xyz", strict=True)), F.lit(1.0).alias("occupancy"), F.lit(2.0).alias("bfactor"), F.lit("C").alias("element"), F.lit(False).alias("is_het"))
    lines = sinks.pdb_lines(atoms).withColumn("model", F.lit(0))
    assert {len(r.value) for r in lines.collect()} == {78}
    read = structures.pdb_atoms(lines.select("item", "model", "value"))
    assert {(r.serial, r.name, r.chain_id, r.seq_num, r.x, r.y, r.z, r.element) for r in read.collect()} == {(s, "CA", "A", 7, 1.5, -2.5, 3.5, "C") for s in SERIALS}
    by_line = {datasource._pdb_values("a", 0, r.value)[2] for r in lines.collect()}
    assert by_line == set(SERIALS)


@pytest.mark.parametrize("serial", [7, 100_000, 43_770_016])
def test_lines_pushed_by_a_long_serial_number(spark, serial):
    line = f"HETATM{serial:5d}  H   GRD A   3    {1.5:8.3f}{-2.5:8.3f}{3.5:8.3f}  1.00  4.00    0.75"
    got = structures.pdb_atoms(spark.createDataFrame([("a", 0, line)], "item string, model int, value string")).first()
    assert (got.serial, got.res_name, got.chain_id, got.seq_num, got.x, got.y, got.z, got.bfactor) == (serial, "GRD", "A", 3, 1.5, -2.5, 3.5, 4.0)
    assert structures.aligned_line(line) == spark.createDataFrame([(line,)], "v string").select(structures.aligned(F.col("v"))).first()[0]
    lines = spark.createDataFrame([("a", 1, line)], "item string, line_no long, value string")
    assert [(r.score, r.x) for r in pockets.lise(lines).collect()] == [(0.75, 1.5)]
    assert [(r.score, r.x) for r in pockets.concavity(lines).collect()] == [(4.0, 1.5)]
    assert [r.serial for r in tables.ter_groups(lines).collect()] == [serial]
    at = f"ATOM  {serial:5d} XXX  HOH X   1    {1.5:8.3f}{-2.5:8.3f}{3.5:8.3f}{0.5:6.2f}  0.00"
    centers = spark.createDataFrame([("a", 1, at), ("b", 1, at.replace("XXX  HOH X", " MPT PKT M"))], "item string, line_no long, value string")
    assert [(r.score, r.x, r.y, r.z) for r in pockets.deepsite(centers).collect()] == [(0.5, 1.5, -2.5, 3.5)]
    assert [(r.score, r.x, r.y, r.z) for r in pockets.metapocket(centers).collect()] == [(0.5, 1.5, -2.5, 3.5)]


def test_scores_of_lines_that_share_a_serial_number(spark):
    lines = spark.createDataFrame([("a", n, f"HETATM    1  H   GRD A   3    {n:8.3f}{0.0:8.3f}{0.0:8.3f}  1.00  0.00    0.{n}5") for n in (1, 2)], "item string, line_no long, value string")
    assert sorted((r.rank, r.score, r.x) for r in pockets.lise(lines).collect()) == [(1, 0.15, 1.0), (2, 0.25, 2.0)]


@pytest.mark.parametrize("most", [0, 50, 4_000_000])
def test_close_components_equal_those_of_all_pairs(spark, most):
    rnd = random.Random(5)
    # a crowd, copies, loose points, two walls just apart and two just touching, and points exactly r apart
    rows = [(rnd.gauss(0, 0.5), rnd.gauss(0, 0.5), rnd.gauss(0, 0.5)) for _ in range(80)] + [(40.0, 40.0, 40.0)] * 10
    rows += [(rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(120)]
    rows += [(x, 100 + i * 0.2, 0.0) for i in range(10) for x in (0.0, 1.001, 50.0, 50.999)] + [(-3.0 + n, -50.0, 7.0) for n in range(5)]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    p = spark.createDataFrame([(n % 2, i, *map(float, x)) for n, (i, x) in enumerate(zip(ids, rows, strict=True))], "g int, id long, x double, y double, z double")
    for item in (None, "g"):
        want = components(p, S.close_pairs(p, 1.0, item), "id", "id", "id_r", item=item)
        got = close_components(p, 1.0, item, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _brute(queries, targets, k, key=lambda t: t[0], r=math.inf, different=False):
    out = set()
    for i, *a in queries:
        near = {}
        for t in targets:
            x, y, z = (u - v for u, v in zip(a, t[1:4], strict=True))
            d = x * x + y * y + z * z
            if d <= r * r and not (different and t[0] == i):
                near[key(t)] = min(d, near.get(key(t), math.inf))
        out |= {(i, n, d, rank) for rank, (d, n) in enumerate(sorted((d, n) for n, d in near.items())[:k], 1)}
    return out


def _crowds():
    rnd = random.Random(8)
    at = [(rnd.gauss(0, 0.01), rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for _ in range(150)] + [(2.0, 2.0, 2.0)] * 60
    at += [(rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(90)] + [(500.0, 0.0, 0.0), (501.0, 0.0, 0.0), (-300.0, 4.0, 0.0)]
    return [(i, *x) for i, x in enumerate(at)]


@pytest.mark.parametrize("different", [False, True])
def test_nearest_in_crowds_and_copies(spark, monkeypatch, different):
    rows = _crowds()
    monkeypatch.setattr(S, "SEARCH_PAIRS", 2)
    asked = []
    join = S.radius_join
    monkeypatch.setattr(S, "radius_join", lambda a, b, r, *more: asked.append(r) or join(a, b, r, *more))
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    t = p if different else p.where("id % 3 = 0")
    got = {(r.id, r.id_r, r.d2, r["rank"]) for r in S.knn(p, t, 4, 8.0, different).collect()}
    assert got == _brute(rows, [x for x in rows if different or x[0] % 3 == 0], 4, different=different)
    # crowds are not joined within the whole radius first
    assert asked[0] < 1 and asked == sorted(asked)


def test_nearest_letters_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(S, "SEARCH_PAIRS", 2)
    rows = _crowds()
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    res = p.select((F.col("id") % 40).alias("residue"), F.char(65 + F.col("id") % 20).alias("letter"), "x", "y", "z")
    got = {r.id: r.letters for r in X.nearest_letters(p, res, 4, 3.0).collect()}
    want = _brute(rows, rows, 4, key=lambda t: t[0] % 40, r=3.0)
    assert got == {i: [chr(65 + n % 20) for _, n in sorted((rank, n) for j, n, _, rank in want if j == i)] for i, *_ in rows}


@pytest.mark.parametrize("smooth", [False, True])
def test_pair_histogram_of_tiles_equals_pairs(spark, smooth):
    rnd = np.random.default_rng(4)
    # atoms on a grid are at the limits of bins exactly, and some are copies
    at = np.concatenate((rnd.normal(0, 2.5, (900, 3)), rnd.integers(-4, 5, (300, 3)).astype(float), np.zeros((40, 3)), [[300.0, 0.0, 0.0]]))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "id long, x double, y double, z double")
    asked = p.where("id % 60 = 0 or id in (1239, 1240)")
    got = {r.id: list(r)[1:] for r in X.pair_histogram(asked, p, 5.0, smooth=smooth).collect()}
    assert len(got) == asked.count()
    for i, bins in got.items():
        d = at[i] - at
        mine = at[d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2 <= 25]
        u, v = np.triu_indices(len(mine))
        d = mine[u] - mine[v]
        d = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2)
        if smooth:
            pos = np.minimum(d / 2.5, 4)
            want = [np.maximum(1 - np.abs(pos - b), 0).sum() for b in range(5)]
        else:
            want = np.bincount(np.minimum(np.floor(d / 2), 4).astype(int), minlength=5)
        assert np.allclose(bins, want, rtol=1e-9 if smooth else 0, atol=1e-6 if smooth else 0)
