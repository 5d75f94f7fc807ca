"""Folds, subsets and class balance. Choices follow an arithmetic hash of the id, so they
are the same in every engine and on every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(id_col: str, seed: int = 42, modulus: int = 10007) -> Column:
    """A small pseudo-random number of an id."""
    return F.pmod((F.col(id_col) + seed) * F.lit(7919), F.lit(modulus))


def folds(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Fold 0..k-1 of each row by a hash of its id: even in expectation, without an order over all rows."""
    return df.withColumn("fold", F.pmod(hashed(id_col, seed), F.lit(k)))


def exact_folds(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Folds whose sizes differ by one at most: shuffled by hash and dealt in turn.

    The turn of a row is counted within ranges of the hash and over the ranges, so no
    task sees all rows. Fewer rows than folds are an error.
    """
    from pyspark.sql.window import Window

    df = df.withColumn("_h", hashed(id_col, seed))
    ranges = df.groupBy("_h").agg(F.count("*").alias("_n"))
    # at most ``modulus`` rows
    w = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_h", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_h").orderBy(id_col)) - 1
    out = df.join(ranges, "_h").withColumn("fold", F.pmod(F.col("_before") + place, F.lit(k)))
    few = F.assert_true(F.col("_all") >= k, F.lit("fewer rows than folds"))
    return out.where(few.isNull()).drop("_h", "_before", "_all")


def subset(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the least hash of their id."""
    return df.withColumn("_h", hashed(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def share(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """About a fraction of the rows."""
    return df.where(hashed(id_col, seed) < fraction * 10007)


def resampled(df: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """Whole copies for the integer part of a ratio and a subsample for its fraction; copy counts from 0."""
    whole = int(ratio)
    copies = F.lit(whole) + F.when(hashed(id_col, seed) < (ratio - whole) * 10007, 1).otherwise(0)
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))


def balanced(df: DataFrame, id_col: str, label: str, target: float, supersample: bool = True, seed: int = 42) -> DataFrame:
    """Positives and negatives brought to target = positives / negatives.

    Too few positives are copied (or else negatives dropped), too many dropped (or else
    negatives copied). Nothing is done if less than one row would change.
    """
    n = df.agg(F.sum(F.col(label).cast("long")), F.count("*")).first()
    pos, neg = (n[0] or 0), (n[1] or 0) - (n[0] or 0)
    if not pos or not neg or abs(pos - target * neg) < 1:
        return df.withColumn("copy", F.lit(0))
    more_positives = target * neg / pos
    if (more_positives > 1) == supersample:
        return resampled(df.where(label), id_col, more_positives, seed).unionByName(df.where(~F.col(label)).withColumn("copy", F.lit(0)))
    return resampled(df.where(~F.col(label)), id_col, 1 / more_positives, seed).unionByName(df.where(label).withColumn("copy", F.lit(0)))


def class_weights(df: DataFrame, label: str, target: float) -> DataFrame:
    """weight: target / ratio for positives, 1 for negatives, ratio being positives / negatives."""
    n = df.agg((F.sum(F.col(label).cast("long")) / F.sum((~F.col(label)).cast("long"))).alias("ratio"))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", F.when(F.col(label), F.lit(target) / F.col("ratio")).otherwise(1.0)).drop("ratio")


def unit(*of: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) by the MD5 of some values, the same in every engine."""
    said = F.concat_ws(":", *(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in of))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / 4294967296.0


def random_points(spark, low: tuple[float, float, float], high: tuple[float, float, float], n: int, seed: int = 42) -> DataFrame:
    """n points spread over a box: (id, x, y, z), the same on every run and retry."""
    return spark.range(n).select("id", *((F.lit(u) + unit("id", F.lit(seed), F.lit(c)) * (v - u)).alias(c) for c, u, v in zip("xyz", low, high, strict=True)))


def _lattice(boxes: DataFrame, by: str, edge: float) -> DataFrame:
    """Grid points of each box, as by ``spatial.lattice``."""
    for c in "xyz":
        width = F.col(f"max_{c}") - F.col(f"min_{c}")
        start = F.col(f"min_{c}") + (width - edge * F.rint(width / edge))
        boxes = boxes.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.floor(width / edge).cast("int")))).withColumn(c, start + F.col(f"i{c}") * edge)
    wide = F.lit(1 << 20).cast("long")
    return boxes.select(by, ((F.col("ix") * wide + F.col("iy")) * wide + F.col("iz")).alias("id"), "x", "y", "z")


def _scattered(boxes: DataFrame, by: str, edge: float, seed: int) -> DataFrame:
    """Random points of each box, one to each edge**3 of its volume, one at least."""
    width = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    n = F.greatest(F.lit(1), F.floor(width["x"] * width["y"] * width["z"] / F.lit(edge**3)).cast("int"))
    x = boxes.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return x.select(by, "id", *((F.col(f"min_{c}") + unit(by, "id", F.lit(seed), F.lit(c)) * width[c]).alias(c) for c in "xyz"))


def sampled_points(
    strategy: str, pocket: DataFrame, protein: DataFrame, surface: DataFrame | None = None, most: float = 4.0, least: float = 2.5, edge: float = 2.0, by: str | None = None, seed: int = 42
) -> DataFrame:
    """(by,) id, x, y, z of points to score around pockets: `surface`, `atoms`, `grid` or `random`.

    Surface points are those within ``most`` of the pocket; grid and random points also
    keep ``least`` from the protein. by: column that tells pockets, and their proteins and
    surfaces, apart; each has a box of its own. Ids are unique in a pocket.
    """
    from orrery.operators import spatial as S

    key = by or "_all"
    named = lambda df: df if by else df.withColumn("_all", F.lit(0))
    pocket, protein = named(pocket), named(protein)
    if strategy == "atoms":
        out = pocket
    elif strategy == "surface":
        if surface is None:
            raise ValueError("sampling from the surface needs its points")
        out = S.shell(named(surface), pocket, most, key)
    elif strategy in ("grid", "random"):
        boxes = S.bounds(pocket, most, key)
        points = _lattice(boxes, key, edge) if strategy == "grid" else _scattered(boxes, key, edge, seed)
        out = S.distant(S.shell(points, pocket, most, key), protein, least, key)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return out.select(*([by] if by else []), "id", *S.XYZ)
