"""Spatial joins over points (id, x, y, z), optionally within an item.

A plain distance condition would be planned as a nested loop. Points are put into cubes
with the radius as edge instead, one side is replicated to the 27 cubes around, and an
equi-join on the cube with a residual distance test gives the exact pairs. Cubes with
many points are dealt in slices, each of which meets the other side in a task of its own.
Distances stay squared.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.session import cut

XYZ = ("x", "y", "z")


def d2(a: str = "", b: str = "_r") -> Column:
    """Squared distance between the coordinates with the suffixes ``a`` and ``b``."""
    return reduce(lambda s, t: s + t, ((F.col(c + a) - F.col(c + b)) * (F.col(c + a) - F.col(c + b)) for c in XYZ))


def _cells(df: DataFrame, r: float, suffix: str = "") -> DataFrame:
    return df.withColumns({f"_c{c}": F.floor(F.col(c + suffix) / F.lit(float(r))).cast("long") for c in XYZ})


_CELL = ("_cx", "_cy", "_cz")
#: Points of a cube that one task compares with the points around.
CUBE_ROWS = 4096


def _around(df: DataFrame, ahead: bool = False) -> DataFrame:
    """Rows at the 27 cubes around their own, or at their own and the 13 ``ahead`` of it."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if not ahead or (i, j, k) >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*(F.lit(v).alias(n) for v, n in zip(s, XYZ, strict=True)), F.lit(s == (0, 0, 0)).alias("own")) for s in steps])
    df = df.withColumn("_o", F.explode(offsets))
    return df.withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_o.{c}") for c in XYZ} | {"_own": F.col("_o.own")}).drop("_o")


def _sliced(left: DataFrame, probe: DataFrame, item: str | None, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a slice: a cube of many points on the left is dealt in slices, and the
    right side's points go to each. Without such cubes the joins with their table fall away."""
    by = [*_CELL, *(["_item"] if item else [])]
    many = left.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("_slices")).where("_slices > 1")
    count = F.coalesce("_slices", F.lit(1))
    place = F.pmod(F.xxhash64(*XYZ, F.monotonically_increasing_id()), count).cast("int")
    left = left.join(many, by, "left").withColumn("_slice", place).drop("_slices")
    probe = probe.join(many, by, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), count - 1))).drop("_slices")
    return left, probe, [*by, "_slice"]


def neighbourhoods(left: DataFrame, right: DataFrame, r: float, item: str | None = None, rows: int = CUBE_ROWS, ahead: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns by which they meet: a point of ``left`` is in one place, and so is every point of
    ``right`` within r of it. Columns of ``right`` get the suffix _r. rows: points of ``left`` in one place."""
    if r <= 0:
        raise ValueError("the radius must be positive")
    named = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns))
    probe = _around(_cells(named, r, "_r"), ahead)
    own = _cells(left, r)
    if item:
        own, probe = own.withColumn("_item", F.col(item)), probe.withColumn("_item", F.col(f"{item}_r"))
    return _sliced(own, probe, item, rows)


def _meeting(left: DataFrame, right: DataFrame, r: float, item: str | None, rows: int, ahead: bool) -> DataFrame:
    own, probe, on = neighbourhoods(left, right, r, item, rows, ahead)
    return own.join(probe, on).withColumn("d2", d2()).where(F.col("d2") <= F.lit(float(r) * float(r)))


def radius_join(left: DataFrame, right: DataFrame, r: float, item: str | None = None, rows: int = CUBE_ROWS) -> DataFrame:
    """All pairs with squared distance d2 <= r*r (inclusive). Columns of ``right`` get the suffix _r.

    ``right`` is replicated, so give the smaller side there. rows: points of ``left`` in a
    cube that meet the other side in one task.
    """
    return _meeting(left, right, r, item, rows, False).select(*left.columns, *(f"{c}_r" for c in right.columns), "d2")


def close_pairs(points: DataFrame, r: float, item: str | None = None, rows: int = CUBE_ROWS) -> DataFrame:
    """(item,) id, id_r, d2 of the pairs of points within r of each other, id < id_r, each once.

    A point meets its own cube and half of those around, so no pair is made twice.
    """
    own = points.select("id", *XYZ, *([item] if item else []))
    pairs = _meeting(own, own, r, item, rows, True).where("not _own or id < id_r")
    return pairs.select(*([item] if item else []), F.least("id", "id_r").alias("id"), F.greatest("id", "id_r").alias("id_r"), "d2").where("id < id_r")


def shared_item(*frames: DataFrame) -> str | None:
    """`item` if all frames tell items apart by a column of that name."""
    return "item" if all("item" in f.columns for f in frames) else None


def near(points: DataFrame, atoms: DataFrame, columns: list[str], r: float) -> DataFrame:
    """``radius_join`` of points and atoms with the given columns of the atoms, within items if both have them."""
    item = shared_item(points, atoms)
    by = [item] if item else []
    return radius_join(points.select("id", *XYZ, *by), atoms.select(*columns, *XYZ, *by), r, item)


def sphere(points: DataFrame, center: tuple[float, float, float], r: float) -> DataFrame:
    """Points within r of a fixed center, boundary included. The box goes first, as the scan can skip by it."""
    for c, v in zip(XYZ, center, strict=True):
        points = points.where(F.col(c).between(v - r, v + r))
    dist = reduce(lambda s, t: s + t, ((F.col(c) - v) * (F.col(c) - v) for c, v in zip(XYZ, center, strict=True)))
    return points.where(dist <= r * r)


def shell(points: DataFrame, targets: DataFrame, r: float, item: str | None = None) -> DataFrame:
    """Points within r of any target (of their item), each once; no target, no point."""
    by = [item] if item else []
    found = radius_join(points.select("id", *XYZ, *by), targets.select(*XYZ, *by), r, item)
    return points.join(found.select("id", *by).distinct(), ["id", *by], "left_semi")


def distant(points: DataFrame, targets: DataFrame, r: float, item: str | None = None) -> DataFrame:
    """Points at least r away from every target: a point at d2 < r*r is out, one at exactly r stays."""
    by = [item] if item else []
    found = radius_join(points.select("id", *XYZ, *by), targets.select(*XYZ, *by), r, item)
    return points.join(found.where(F.col("d2") < float(r) * float(r)).select("id", *by).distinct(), ["id", *by], "left_anti")


#: Steps from a cube to its parent: 4 cubes along each axis.
_UP = 2


def _boxes(targets: DataFrame, edge: float, levels: int, by: list[str]) -> DataFrame:
    """Cubes of each level that hold targets, with their parent, number and box; level 0 has the finest.

    Each level is summed from the one below, so the points are counted once.
    """
    box = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    at = _cells(targets, edge).groupBy(*by, *_CELL).agg(F.count("*").alias("n"), *box)
    parts = []
    for level in range(levels + 1):
        up = [F.floor(F.col(c) / (1 << _UP)).cast("long").alias(f"p{c}") for c in _CELL]
        parts.append(at.select(F.lit(level).alias("level"), *by, *_CELL, *up, "n", *(f"{n}_{c}" for c in XYZ for n in ("lo", "hi"))))
        again = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
        at = parts[-1].groupBy(*by, *(F.col(f"p{c}").alias(c) for c in _CELL)).agg(F.sum("n").alias("n"), *again)
    return reduce(DataFrame.unionByName, parts)


def _descent(q: DataFrame, t: DataFrame, k: int, edge: float, span: float, by: list[str]) -> DataFrame:
    """The cubes that can hold one of the k nearest targets of each query, and the targets in them.

    From the coarsest cubes down, a query keeps those that begin no farther away than the
    nearest cubes with k targets end, so what it reads depends on k and not on how far
    away, or how dense, the targets are.
    """
    levels = 0
    while edge * (1 << (_UP * levels)) < span and levels < 24:
        levels += 1
    boxes = cut(_boxes(t, edge, levels, by))
    gap = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
    far = lambda c: F.greatest(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(c))
    sq = lambda f: reduce(lambda a, b: a + b, (f(c) * f(c) for c in XYZ))
    order = Window.partitionBy("id").orderBy("_end", *_CELL)
    # at the top a handful of cubes holds all targets, or all of an item
    top = boxes.where(F.col("level") == levels)
    open_ = q.join(top, by) if by else q.crossJoin(F.broadcast(top))
    for level in range(levels, -1, -1):
        if level < levels:
            below = boxes.where(F.col("level") == level)
            up = open_.select("id", *by, *XYZ, *(F.col(c).alias(f"p{c}") for c in _CELL))
            open_ = up.join(below, [*by, *(f"p{c}" for c in _CELL)])
        open_ = open_.withColumn("_begin", sq(gap)).withColumn("_end", sq(far))
        held = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        open_ = open_.withColumn("_before", F.coalesce(held, F.lit(0)))
        # the end of the cube that completes k
        bound = F.min(F.when(F.col("_before") + F.col("n") >= k, F.col("_end"))).over(Window.partitionBy("id"))
        open_ = open_.withColumn("_bound", bound).where("_bound is null or _begin <= _bound * (1 + 1e-9) + 1e-12")
        if level % 4 == 0:
            open_ = cut(open_.select("id", *by, *XYZ, *_CELL))
    named = _cells(t, edge).select(*(F.col(c).alias(f"{c}_r") for c in ("id", *XYZ)), *by, *_CELL)
    return open_.join(named, [*by, *_CELL]).withColumn("d2", d2())


#: Pairs that a search may make for each query and wanted target.
SEARCH_PAIRS = 32


def _first_radius(q: DataFrame, t: DataFrame, k: int, r: float, by: list[str]) -> float:
    """r, halved until the points of the same cubes are few for each query; a hint only."""
    n = q.count()
    for _ in range(30):
        side = lambda df, name: _cells(df, r).groupBy(*by, *_CELL).agg(F.count("*").cast("double").alias(name))
        # a ball holds some four cubes
        made = side(q, "_q").join(side(t, "_t"), [*by, *_CELL]).agg(F.sum(4 * F.col("_q") * F.col("_t"))).first()[0] or 0.0
        if made <= float(SEARCH_PAIRS) * k * n:
            break
        r /= 2
    return r


def nearest_within(queries: DataFrame, targets: DataFrame, k: int, r: float, key: str = "id", more: tuple[str, ...] = (), different: bool = False, item: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """The k nearest keys within r of each query: id, {key}_r, more_r, d2, rank, ties to the smaller key; then the
    queries with fewer, the targets that count, and the first radius.

    A key is as near as its nearest target. The search begins within a radius that finds a query
    few targets, and only those not settled go on to twice the radius, up to r, so crowds are
    never joined within the whole of r. Of targets at the same place those of the k smallest keys count.
    """
    by = [item] if item else []
    q = queries.select("id", *XYZ, *by)
    t = targets.groupBy(key, *XYZ, *by).agg(*(F.min(c).alias(c) for c in more)) if key != "id" else targets.select("id", *XYZ, *by)
    same = Window.partitionBy(*XYZ, *by).orderBy(key)
    t = cut(t.withColumn("_k", F.row_number().over(same)).where(F.col("_k") <= k + different).drop("_k"))
    w = Window.partitionBy("id").orderBy("d2", f"{key}_r")

    def best(pairs):
        pairs = pairs.where("id <> id_r") if different else pairs
        if key != "id":
            pairs = pairs.groupBy("id", f"{key}_r").agg(F.min("d2").alias("d2"), *(F.min(f"{c}_r").alias(f"{c}_r") for c in more))
        return pairs.select("id", f"{key}_r", *(f"{c}_r" for c in more), "d2").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    rest, found = q, None
    first = reach = _first_radius(q, t, k, float(r), by)
    while True:
        close = cut(best(radius_join(rest, t, reach, item)))
        settled = close.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("id")
        rest = cut(rest.join(settled, "id", "left_anti"))
        last = reach >= r or rest.isEmpty()
        got = close if last else close.join(settled, "id", "left_semi")
        found = got if found is None else found.unionByName(got)
        if last:
            return found, rest, t, first
        reach = min(reach * 2, float(r))


def knn(queries: DataFrame, targets: DataFrame, k: int, r: float, different: bool = False, item: str | None = None) -> DataFrame:
    """The k nearest targets of each query: id, id_r, d2, rank; ties go to the smaller id_r.

    Searches within r first. Queries with fewer than k targets there, be they far from all
    targets or the targets few, go down a tree of cubes instead. With ``different`` a target
    with the query's id doesn't count. A query gets fewer than k rows if there are fewer targets.
    item: column within which targets are looked for; ids are unique over all items.
    """
    by = [item] if item else []
    close, rest, t, edge = nearest_within(queries, targets, k, r, different=different, item=item)
    if rest.isEmpty():
        return close
    # of all points one row comes back
    ends = rest.unionByName(t).agg(*(f(c) for c in XYZ for f in (F.min, F.max))).first()
    span = max(max(abs(float(v or 0)) for v in ends), float(r)) * 2
    pairs = _descent(rest, t, k + different, edge, span, by)
    pairs = pairs.where("id <> id_r") if different else pairs
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "id_r"))
    found = pairs.select("id", "id_r", "d2").withColumn("rank", rank).where(F.col("rank") <= k)
    return close.join(rest.select("id"), "id", "left_anti").unionByName(found)


def nearest(queries: DataFrame, targets: DataFrame, r: float, different: bool = False, item: str | None = None) -> DataFrame:
    """The nearest target of each query."""
    return knn(queries, targets, 1, r, different, item).drop("rank")


def min_distance(groups_a: DataFrame, groups_b: DataFrame, r: float) -> DataFrame:
    """Least squared distance between the points of each pair of groups, as far as it is <= r*r.

    Groups are given by a column ``grp``; pairs farther apart than r have no row (infinite). Groups of
    different items don't meet.
    """
    item = shared_item(groups_a, groups_b)
    by = [item] if item else []
    pairs = radius_join(groups_a.select("grp", *XYZ, *by), groups_b.select("grp", *XYZ, *by), r, item)
    return pairs.groupBy(F.col("grp").alias("grp_a"), F.col("grp_r").alias("grp_b")).agg(F.min("d2").alias("min_d2"))


def bounds(points: DataFrame, margin: float = 0.0, by: str | None = None) -> DataFrame:
    """Box around the points, per group, widened by a margin."""
    aggs = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    box = (points.groupBy(by) if by else points).agg(*aggs)
    return box.withColumns({f"{n}_{c}": F.col(f"{n}_{c}") + F.lit(s * margin) for c in XYZ for n, s in (("min", -1.0), ("max", 1.0))})


def in_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points inside a box, faces included."""
    return points.where(reduce(lambda a, b: a & b, (F.col(c).between(u, v) for c, u, v in zip(XYZ, low, high, strict=True))))


def centroid(points: DataFrame, by: str, mass: str | None = None) -> DataFrame:
    """Mean of the coordinates per group, weighted by a mass column if given."""
    if mass is None:
        return points.groupBy(by).agg(*(F.avg(c).alias(c) for c in XYZ))
    return points.groupBy(by).agg(*(F.try_divide(F.sum(F.col(mass) * F.col(c)), F.sum(mass)).alias(c) for c in XYZ))


def lattice(spark, low: tuple[float, float, float], high: tuple[float, float, float], edge: float) -> DataFrame:
    """Grid points of a box: per axis floor(width / edge) + 1 steps from the lower face plus the IEEE remainder of the width."""
    axes = []
    for c, u, v in zip(XYZ, low, high, strict=True):
        n, start = int((v - u) / edge), u + math.remainder(v - u, edge)
        axes.append(spark.range(n + 1).select(F.col("id").alias(f"i{c}"), (F.lit(start) + F.col("id") * F.lit(float(edge))).alias(c)))
    return axes[0].crossJoin(axes[1]).crossJoin(axes[2])


def rotated(points: DataFrame, rotations: DataFrame) -> DataFrame:
    """Each point under each rotation; rotations has rot and the rows of the matrix m11 .. m33."""
    turned = {c: reduce(lambda s, t: s + t, (F.col(f"m{i}{j}") * F.col(p) for j, p in enumerate(XYZ, 1))) for i, c in enumerate(XYZ, 1)}
    both = points.crossJoin(F.broadcast(rotations))
    return both.select(*(c for c in points.columns if c not in XYZ), "rot", *(e.alias(c) for c, e in turned.items()))


def random_turns(item: Column, rot: Column, seed: int) -> dict[str, Column]:
    """m11 .. m33: the matrix of a rotation drawn evenly over all, from a hash of seed, item and number.

    Three even numbers give a unit quaternion (two points on circles, weighted by the square
    roots of a number and its rest), and that the matrix. Nothing is drawn when a task runs, so a task that is run
    again turns alike.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string"), rot.cast("string")).cast("binary"))
    u = [F.conv(F.substring(digest, 1 + 10 * n, 10), 16, 10).cast("double") / float(1 << 40) for n in range(3)]
    turn = [2 * math.pi * v for v in u[1:]]
    x, y, z, w = (F.sqrt(r) * f(t) for r, f, t in ((1 - u[0], F.sin, turn[0]), (1 - u[0], F.cos, turn[0]), (u[0], F.sin, turn[1]), (u[0], F.cos, turn[1])))
    return {
        "m11": 1 - 2 * (y * y + z * z), "m12": 2 * (x * y - z * w), "m13": 2 * (x * z + y * w),
        "m21": 2 * (x * y + z * w), "m22": 1 - 2 * (x * x + z * z), "m23": 2 * (y * z - x * w),
        "m31": 2 * (x * z - y * w), "m32": 2 * (y * z + x * w), "m33": 1 - 2 * (x * x + y * y),
    }


def randomly_rotated(points: DataFrame, item: str, copies: int, seed: int = 42) -> DataFrame:
    """The points as they are (rot 0) and turned about the origin ``copies`` times; points of an item turn together."""
    both = points.withColumn("rot", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    m = both.withColumns(random_turns(F.col(item), F.col("rot"), seed))
    turned = {c: reduce(lambda s, t: s + t, (F.col(f"m{i}{j}") * F.col(p) for j, p in enumerate(XYZ, 1))) for i, c in enumerate(XYZ, 1)}
    return m.select(*(c for c in points.columns if c not in XYZ), "rot", *(F.when(F.col("rot") == 0, F.col(c)).otherwise(v).alias(c) for c, v in turned.items()))


def thinned(points: DataFrame, item: str, distance: float = 0.05, local_edges: int = 200_000) -> DataFrame:
    """Greedy thinning in id order: a point stays if no kept point of its item is within ``distance``.

    That is the lexicographically first independent set of the graph of close pairs. Each
    round keeps the points that wait for no smaller one and drops those beside them, all over
    the table at once. Long chains would take many rounds, so that once ``local_edges`` pairs or fewer are left,
    these are gone through in order, item by item.
    """
    edges = cut(close_pairs(points.select("id", *XYZ, item), distance, item).select(item, "id", "id_r"))
    dropped = None
    while (left := edges.count()) > local_edges:
        waiting = edges.select(item, F.col("id_r").alias("id")).distinct()
        first = edges.select(item, "id").distinct().join(waiting, [item, "id"], "left_anti")
        out = cut(edges.join(first, [item, "id"], "left_semi").select(item, F.col("id_r").alias("id")).distinct())
        # neither the kept ones nor the dropped ones are waited for any more
        both = first.unionByName(out)
        ends = both.withColumnRenamed("id", "id_r")
        edges = cut(edges.join(both, [item, "id"], "left_anti").join(ends, [item, "id_r"], "left_anti"))
        dropped = out if dropped is None else dropped.unionByName(out)
    if left:

        def rest(pdf):
            out: set = set()
            for u, v in pdf[["id", "id_r"]].sort_values(["id", "id_r"]).itertuples(index=False):
                if u not in out:
                    out.add(v)
            pdf = pdf[pdf["id_r"].isin(out)]
            return pdf[[item, "id_r"]].drop_duplicates().rename(columns={"id_r": "id"})

        last = edges.groupBy(item).applyInPandas(rest, points.select(item, "id").schema)
        dropped = last if dropped is None else dropped.unionByName(last)
    return points if dropped is None else points.join(dropped, [item, "id"], "left_anti").select(*points.columns)
