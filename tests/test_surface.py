"""Tessellated surfaces and thinning in rounds."""

import math
import random

import pytest

from orrery.operators import spatial as S
from orrery.operators import surface

ATOM = "item string, serial int, element string, x double, y double, z double"


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_spheres(level):
    p = surface.sphere(level)
    assert len(p) == 10 * 4 ** (level - 1) + 2 == len({tuple(round(c, 9) for c in q[:3]) for q in p})
    assert all(abs(math.hypot(*q[:3]) - 1) < 1e-12 for q in p)
    # twelve corners with five triangles, all others with six
    assert sorted(q[3] for q in p) == [5] * 12 + [6] * (len(p) - 12)
    assert all(abs(sum(q[k] * q[3] for q in p)) < 1e-9 for k in range(3))


def test_levels_have_bounds():
    with pytest.raises(ValueError):
        surface.sphere(0)


def test_two_spheres(spark):
    """The area that is left nears the exact one with the level."""
    rows = [("one", 1, "C", 0.0, 0.0, 0.0), ("two", 1, "C", 0.0, 0.0, 0.0), ("two", 2, "C", 3.0, 0.0, 0.0), ("apart", 1, "O", 0.0, 0.0, 0.0), ("apart", 2, "N", 50.0, 0.0, 0.0), ("same", 1, "C", 0.0, 0.0, 0.0), ("same", 2, "C", 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, ATOM)
    whole = lambda r: 4 * math.pi * r * r
    for level, off in ((2, 0.12), (4, 0.03)):
        got = {(r.item, r.serial): r.asa for r in surface.areas(atoms, surface.exposed_points(atoms, 1.6, level)).collect()}
        assert got["one", 1] == pytest.approx(whole(3.3)) and got["apart", 1] == pytest.approx(whole(3.12)) and got["apart", 2] == pytest.approx(whole(3.15))
        # of either sphere a cap of height r - 1.5 is covered
        exact = whole(3.3) - 2 * math.pi * 3.3 * (3.3 - 1.5)
        assert abs(got["two", 1] - exact) < off * exact and got["two", 1] == pytest.approx(got["two", 2], rel=2 * off)
        assert got["same", 1] == pytest.approx(whole(3.3)) and got["same", 2] == pytest.approx(whole(3.3))


def test_points_against_all_spheres(spark):
    r = random.Random(5)
    rows = [(i, n, "CNOSX"[n % 5], *(r.uniform(0, 12) for _ in "xyz")) for i in "ab" for n in range(25)]
    atoms = spark.createDataFrame(rows, ATOM).repartition(4)
    got = {(p.item, p.serial, p.n) for p in surface.exposed_points(atoms, 1.4, 2).collect()}
    rad = lambda e: surface.RADII.get(e, surface.OTHER) + 1.4
    want = set()
    for item, s, e, *at in rows:
        for n, (*d, _) in enumerate(surface.sphere(2)):
            p = [c + rad(e) * v for c, v in zip(at, d, strict=True)]
            if not any(i == item and t != s and math.dist(p, o) ** 2 < rad(f) ** 2 - 1e-9 for i, t, f, *o in rows):
                want.add((item, s, n))
    assert got == want and 0 < len(want) < 50 * 42


@pytest.mark.parametrize("local", [0, 40, 10**6])
def test_thinning_in_rounds_is_greedy(spark, local):
    r = random.Random(9)
    rows = [(i, n, r.uniform(0, 6), r.uniform(0, 6), 0.0) for i in "ab" for n in r.sample(range(1000), 120)]
    rows += [("line", n, n * 0.9, 0.0, 0.0) for n in range(15)] + [("alone", 3, 0.0, 0.0, 0.0), ("same", 1, 0.0, 0.0, 0.0), ("same", 2, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "item string, id long, x double, y double, z double").repartition(5)
    kept: dict = {}
    for i, n, *at in sorted(rows):
        if all(math.dist(at, q) > 1.0 for _, q in kept.setdefault(i, [])):
            kept[i].append((n, at))
    got = {(p.item, p.id) for p in S.thinned(points, "item", 1.0, local_edges=local).collect()}
    assert got == {(i, n) for i, v in kept.items() for n, _ in v}
