"""Pocket prediction: threshold, cluster, extend, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.aggregate import pocket_scores
from orrery.operators.components import close_components, large_enough
from orrery.operators.spatial import XYZ, radius_join
from orrery.params import Params


def pocket_members(points: DataFrame, p: Params | None = None) -> DataFrame:
    """(item, component, id) of pockets: clusters of high-scoring points with the points around them.

    points: item, id (unique over all items), x, y, z, score. A point may belong to more
    than one pocket.
    """
    p = p or Params()
    hot = points.where(F.col("score") >= p.pred_point_threshold)
    near = ["item", "id", *XYZ]
    of = close_components(hot, p.pred_clustering_dist, "item")
    big = large_enough(of, p.pred_min_cluster_size)
    core = hot.select(*near).join(of.join(big, "component").select("id", "component"), "id")
    around = radius_join(points.select(*near), core.select("item", "component", *XYZ), p.extended_pocket_cutoff, "item")
    return around.select("item", F.col("component_r").alias("component"), "id").distinct()


def predict_pockets(points: DataFrame, p: Params | None = None) -> DataFrame:
    """Ranked pockets of each item: name, rank, component (its least core point), score, n_points and centroid.

    The score is the sum of the members' transformed scores, of the score_point_limit
    best ones if that is set. Ties go to the smaller component.
    """
    p = p or Params()
    by = ["item", "component"]
    members = pocket_members(points, p).join(points.select("id", *XYZ, "score"), "id")
    scores = pocket_scores(members, by, power=p.point_score_pow, limit=p.score_point_limit)
    centers = members.groupBy(*by).agg(*(F.round(F.avg(c), 5).alias(c) for c in XYZ))
    pockets = scores.join(centers, by).select(*by, F.round("pocket_score", 5).alias("score"), F.col("n").alias("n_points"), *XYZ)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "component"))
    return pockets.withColumn("rank", rank).withColumn("name", F.concat(F.lit("pocket"), F.col("rank")))
