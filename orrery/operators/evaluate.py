"""Identification criteria, success rates and summaries of ranked pockets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.spatial import XYZ, radius_join, shared_item


def _close(ligands: DataFrame, points: DataFrame, r: float) -> DataFrame:
    """Pairs within r, of one item if both frames have items."""
    item = shared_item(ligands, points)
    by = [item] if item else []
    return radius_join(ligands.select("id", *XYZ, *by), points.select(*XYZ, *by), r, item)


def within(ligands: DataFrame, points: DataFrame, r: float) -> DataFrame:
    """(id, identified): whether any point of its item lies within r of the ligand atom."""
    near = _close(ligands, points, r).select("id").distinct().withColumn("identified", F.lit(True))
    return ligands.select("id").join(near, "id", "left").select("id", F.coalesce("identified", F.lit(False)).alias("identified"))


def distance_criterion(ligands: DataFrame, pockets: DataFrame, cutoffs: DataFrame, most: float) -> DataFrame:
    """(cutoff, n_identified): ligands with a pocket center of their item within each cutoff, none above ``most``."""
    near = _close(ligands, pockets, most).groupBy("id").agg(F.min("d2").alias("d2"))
    # one row per ligand and cutoff: the cutoffs are a short list
    hit = near.crossJoin(F.broadcast(cutoffs)).where(F.col("d2") <= F.col("cutoff") * F.col("cutoff")).groupBy("cutoff").agg(F.count("*").alias("n"))
    return cutoffs.join(hit, "cutoff", "left").select("cutoff", F.coalesce("n", F.lit(0)).alias("n_identified"))


def overlaps(ligand_sets: DataFrame, pocket_sets: DataFrame) -> DataFrame:
    """(l, p, both, nl, np) of ligand and pocket point sets that share a point."""
    both = ligand_sets.join(pocket_sets, "id").groupBy("l", "p").agg(F.count("*").alias("both"))
    nl = ligand_sets.groupBy("l").agg(F.count("*").alias("nl"))
    np = pocket_sets.groupBy("p").agg(F.count("*").alias("np"))
    return both.join(nl, "l").join(np, "p")


def coverage(ligand: DataFrame, pocket: DataFrame) -> DataFrame:
    """One row: share of the ligand's points in the pocket, and intersection over union; null for empty sets."""
    marks = ligand.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(pocket.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b")).cast("double")
    return marks.agg(F.try_divide(both, F.sum("a").cast("double")).alias("coverage"), F.try_divide(both, F.count("*").cast("double")).alias("overlap"))


def success_rates(ranks: DataFrame, tolerances: tuple[int, ...]) -> DataFrame:
    """Share of ligands whose pocket is among the first n + t of their item. ranks: item, l, rank (-1: none), n.

    One pass: every tolerance is a conditional average, unpivoted at the end.
    """
    hit = lambda t: F.avg(((F.col("rank") > 0) & (F.col("rank") <= F.col("n") + t)).cast("double"))
    wide = ranks.agg(*(hit(t).alias(f"t{t}") for t in tolerances))
    pairs = ", ".join(f"{t}L, t{t}" for t in tolerances)
    return wide.select(F.expr(f"stack({len(tolerances)}, {pairs}) AS (tolerance, rate)"))


def item_success_rates(ranks: DataFrame, tolerances: tuple[int, ...]) -> DataFrame:
    """Like success_rates, but each item weighs the same: hits count 1/n, over the number of items."""
    hit = lambda t: F.sum(F.when((F.col("rank") > 0) & (F.col("rank") <= F.col("n") + t), 1.0 / F.col("n")).otherwise(0.0))
    per = ranks.groupBy("item").agg(*(hit(t).alias(f"t{t}") for t in tolerances))
    wide = per.agg(*(F.avg(f"t{t}").alias(f"t{t}") for t in tolerances))
    pairs = ", ".join(f"{t}L, t{t}" for t in tolerances)
    return wide.select(F.expr(f"stack({len(tolerances)}, {pairs}) AS (tolerance, rate)"))


def evaluation_stats(ranks: DataFrame) -> DataFrame:
    """One row of counts and averages over items and ligands."""
    found = F.col("rank") > 0
    per = ranks.groupBy("item").agg(F.count("*").alias("n"), F.count_if(found).alias("f"), F.sum(F.when(found, F.col("rank"))).alias("r"))
    return per.agg(
        F.count("*").alias("n_items"), F.sum("n").alias("n_ligands"), F.avg("n").alias("ligands_per_item"), F.try_divide(F.sum("r").cast("double"), F.sum("f").cast("double")).alias("avg_rank_found"),
        F.sum("f").alias("n_found"), F.try_divide(F.sum("f").cast("double"), F.sum("n").cast("double")).alias("found_rate"),
    )


def top_averages(points: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """Per group: mean, max, mean of the best three and of the better half (rounded up) of the scores."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    n = F.count("*").over(Window.partitionBy(by))
    x = points.select(by, score, k.alias("_k"), n.alias("_n"))
    return x.groupBy(by).agg(F.avg(score).alias("mean"), F.max(score).alias("max"), F.avg(F.when(F.col("_k") <= 3, F.col(score))).alias("top3"), F.avg(F.when(F.col("_k") <= F.ceil(F.col("_n") / 2), F.col(score))).alias("top_half"))


def rescored(ranks: DataFrame) -> DataFrame:
    """change = old rank - new rank, and a bar of as many + or -."""
    change = F.col("old_rank") - F.col("rank")
    bar = F.concat(F.expr("repeat('+', cast(greatest(old_rank - rank, 0) AS int))"), F.expr("repeat('-', cast(greatest(rank - old_rank, 0) AS int))"))
    return ranks.withColumn("change", change).withColumn("bar", bar)


def overlap_criterion(o: DataFrame, least: float) -> DataFrame:
    """dso: shared points over those of either set, of rows from ``overlaps``; identified from ``least`` on."""
    dso = F.col("both") / (F.col("nl") + F.col("np") - F.col("both"))
    return o.withColumn("dso", dso).withColumn("identified", F.col("dso") >= least)


def weighted_overlap_criterion(o: DataFrame, of_ligand: float, of_pocket: float) -> DataFrame:
    """identified: whether the shared points are enough of the ligand's and enough of the pocket's."""
    return o.withColumn("identified", (F.col("both") / F.col("nl") >= of_ligand) & (F.col("both") / F.col("np") >= of_pocket))


def with_decoys(pockets: DataFrame, by: list[str], true: str, score: str, tie: str, n: int) -> DataFrame:
    """All true pockets of an item and its n best false ones."""
    place = F.row_number().over(Window.partitionBy(*by, true).orderBy(F.desc(score), tie))
    return pockets.withColumn("_n", place).where(F.col(true) | (F.col("_n") <= n)).drop("_n")


def volumes(points: DataFrame, by: list[str], cell: int = 8) -> DataFrame:
    """The volume of each pocket: that of a cell for each of its points."""
    return points.groupBy(*by).agg((F.count("*") * cell).alias("volume"))


def label_agreement(a: DataFrame, b: DataFrame, on: list[str], first: str, second: str) -> DataFrame:
    """One row: how often two labelings of the same things agree and differ."""
    j = a.join(b, on)
    n = lambda u, v: F.count_if((F.col(first) == u) & (F.col(second) == v))
    return j.agg(n(1, 1).alias("both_pos"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))
