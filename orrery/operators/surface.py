"""Solvent accessible surfaces by tessellated spheres.

A sphere is an icosahedron whose triangles are cut into four, level by level, with vertices shared
between triangles. An atom's points lie on its sphere, widened by the probe; those inside the
sphere of another atom are covered. Only atoms whose spheres meet are joined, one row per pair of
them: their points are made and tested on the fly and combined before anything is shuffled.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.spatial import XYZ, radius_join

#: Van der Waals radii by element, and that of all others.
RADII, OTHER = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8}, 1.8


def sphere(level: int) -> list[tuple[float, float, float, int]]:
    """The 10 * 4**(level - 1) + 2 vertices on the unit sphere, from the lowest up, each with the number of
    triangles that meet there."""
    if not 1 <= level <= 6:
        raise ValueError("levels go from 1, an icosahedron, to 6")
    g = (1 + math.sqrt(5)) / 2
    corners = [p for a in (-1.0, 1.0) for b in (-g, g) for p in ((0.0, a, b), (a, b, 0.0), (b, 0.0, a))]
    size = math.sqrt(1 + g * g)
    near = lambda p, q: math.dist(p, q) < 2.1  # noqa: E731  edges have length 2
    triangles = [t for t in combinations(range(12), 3) if all(near(corners[i], corners[j]) for i, j in combinations(t, 2))]
    points = [tuple(c / size for c in p) for p in corners]
    for _ in range(level - 1):
        middle: dict[tuple[int, int], int] = {}

        def between(i: int, j: int, middle=middle) -> int:
            key = (min(i, j), max(i, j))
            if key not in middle:
                m = [a + b for a, b in zip(points[i], points[j], strict=True)]
                middle[key] = len(points)
                points.append(tuple(c / math.hypot(*m) for c in m))
            return middle[key]

        cut = [(i, j, k, between(i, j), between(j, k), between(i, k)) for i, j, k in triangles]
        triangles = [t for i, j, k, ij, jk, ik in cut for t in ((i, ij, ik), (j, ij, jk), (k, jk, ik), (ij, jk, ik))]
    meet = [0] * len(points)
    for t in triangles:
        for i in t:
            meet[i] += 1
    return sorted(((*p, m) for p, m in zip(points, meet, strict=True)), key=lambda p: tuple(round(c, 9) for c in (p[2], p[1], p[0])))


def radius(element: Column, probe: float) -> Column:
    """The radius of an atom's sphere, widened by the probe."""
    known = F.create_map(*(F.lit(v) for kv in RADII.items() for v in kv))
    return F.coalesce(F.element_at(known, element), F.lit(OTHER)) + F.lit(probe)


def exposed_points(atoms: DataFrame, probe: float = 1.6, level: int = 2) -> DataFrame:
    """(item, serial, n, x, y, z, area): the points of each atom's sphere that no other atom of its item covers.

    atoms: item, serial (unique in its item), element, x, y, z. n: the vertex of the sphere. area:
    the point's share of its sphere, by the triangles around it. A point on another's
    sphere is not covered. Atoms at the same place leave each other's points, as in one sphere.
    """
    points = sphere(level)
    kind = "array<struct<n:int,x:double,y:double,z:double,w:int>>"
    # a constant, folded before anything runs
    vertices = F.from_json(F.lit(json.dumps([dict(n=n, x=x, y=y, z=z, w=w) for n, (x, y, z, w) in enumerate(points)])), kind)
    share = 4 * math.pi / sum(p[3] for p in points)
    a = atoms.select("item", "serial", *XYZ, radius(F.col("element"), probe).alias("r"))
    most = 2 * (max(*RADII.values(), OTHER) + probe)
    at = {c: F.col(c) + F.col("r") * F.col(f"d.{c}") for c in XYZ}
    pairs = radius_join(a, a, most, "item").where((F.col("serial") != F.col("serial_r")) & (F.col("d2") < (F.col("r") + F.col("r_r")) * (F.col("r") + F.col("r_r"))))
    made = pairs.select("item", "serial", *XYZ, "r", *(f"{c}_r" for c in XYZ), "r_r", F.explode(vertices).alias("d"))
    inside = sum(((at[c] - F.col(f"{c}_r")) * (at[c] - F.col(f"{c}_r")) for c in XYZ), F.lit(0.0)) < F.col("r_r") * F.col("r_r") - 1e-9
    covered = made.where(inside).select("item", "serial", F.col("d.n").alias("n")).distinct()
    every = a.withColumn("d", F.explode(vertices)).select("item", "serial", F.col("d.n").alias("n"), *(v.alias(c) for c, v in at.items()), (F.col("d.w") * share * F.col("r") * F.col("r")).alias("area"))
    return every.join(covered, ["item", "serial", "n"], "left_anti")


def areas(atoms: DataFrame, exposed: DataFrame) -> DataFrame:
    """(item, serial, asa): the accessible area of each atom, the sum over its exposed points."""
    got = exposed.groupBy("item", "serial").agg(F.sum("area").alias("asa"))
    return atoms.select("item", "serial").join(got, ["item", "serial"], "left").select("item", "serial", F.coalesce("asa", F.lit(0.0)).alias("asa"))
