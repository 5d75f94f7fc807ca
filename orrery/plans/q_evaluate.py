"""Queries that evaluate ranked pockets against ligands."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import aggregate as A
from orrery.operators import evaluate as E
from orrery.operators import windows as W
from orrery.plans.registry import pts, query, r6
from orrery.session import table

_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_L = "lig AS (SELECT id, grp % 2 AS item, x, y, z FROM pts WHERE lig)"
_PK = """pk AS (SELECT grp, grp % 2 AS item, avg(x) AS x, avg(y) AS y, avg(z) AS z, row_number() OVER (PARTITION BY grp % 2 ORDER BY round(sum(score), 6) DESC, grp) AS rank FROM pts WHERE NOT lig GROUP BY grp)"""


def _sides(spark, d):
    p = pts(spark, d)
    total = p.where("not lig").groupBy("grp").agg(*(F.avg(c).alias(c) for c in "xyz"), F.round(F.sum("score"), 6).alias("total"))
    # pockets of two structures, ranked in each
    pockets = W.ranked(total.withColumn("item", F.col("grp") % 2), ["item"], "total", "grp").withColumn("rank", F.col("rank").cast("long"))
    return p.withColumn("item", F.col("grp") % 2), p.where("lig").select("grp", (F.col("grp") % 2).alias("item"), "id", "x", "y", "z"), pockets


@query(
    "d1_dca",
    f"WITH {_L}, {_PK}, c AS (SELECT range + 2 AS cutoff FROM range(11)) SELECT c.cutoff, count(DISTINCT l.id) AS n_identified FROM c LEFT JOIN (SELECT a.id, min({_D2}) AS d2 FROM lig a JOIN pk b USING (item) GROUP BY 1) l ON l.d2 <= c.cutoff * c.cutoff GROUP BY 1",
    "pts",
)
def d1(spark, d):
    p, lig, pk = _sides(spark, d)
    return E.distance_criterion(lig, pk, spark.range(2, 13).select(F.col("id").alias("cutoff")), 12.0)


@query(
    "d2_dcc",
    f"""WITH lc AS (SELECT grp AS id, grp % 2 AS item, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE lig GROUP BY grp), {_PK}, c AS (SELECT range + 4 AS cutoff FROM range(11))
SELECT c.cutoff, count(DISTINCT l.id) AS n_identified FROM c LEFT JOIN (SELECT a.id, min({_D2}) AS d2 FROM lc a JOIN pk b USING (item) GROUP BY 1) l ON l.d2 <= c.cutoff * c.cutoff GROUP BY 1""",
    "pts",
)
def d2_(spark, d):
    p, lig, pk = _sides(spark, d)
    centers = lig.groupBy("item", F.col("grp").alias("id")).agg(*(F.avg(c).alias(c) for c in "xyz"))
    return E.distance_criterion(centers, pk, spark.range(4, 15).select(F.col("id").alias("cutoff")), 14.0)


for _n, _side, _cond in (("d3_dpa", "b.score >= 0.5", "score >= 0.5"), ("d4_dsa", "b.score < 0.5", "score < 0.5")):

    @query(_n, f"SELECT a.id, min({_D2}) <= 6.25 AS identified FROM pts a JOIN pts b ON a.lig AND NOT b.lig AND a.grp % 2 = b.grp % 2 AND {_side} GROUP BY a.id", "pts")
    def d34(spark, d, cond=_cond):
        p, lig, pk = _sides(spark, d)
        return E.within(lig, p.where("not lig").where(cond), 2.5)


_SETS = f"""ls AS (SELECT DISTINCT a.grp AS l, b.id FROM pts a JOIN pts b ON a.lig AND NOT b.lig AND {_D2} <= 16), ps AS (SELECT grp AS p, id FROM pts WHERE NOT lig),
lp AS (SELECT l, p, count(*) AS shared FROM ls JOIN ps USING (id) GROUP BY 1, 2), ln AS (SELECT l, count(*) AS nl FROM ls GROUP BY 1), pn AS (SELECT p, count(*) AS np FROM ps GROUP BY 1),
ov AS (SELECT l, p, shared, nl, np FROM lp JOIN ln USING (l) JOIN pn USING (p))"""


def _overlap(spark, d):
    p, lig, pk = _sides(spark, d)
    from orrery.operators.spatial import radius_join

    near = radius_join(p.where("not lig").select("id", "x", "y", "z"), lig.select("grp", "x", "y", "z"), 4.0).select(F.col("grp_r").alias("l"), "id").distinct()
    return E.overlaps(near, p.where("not lig").select(F.col("grp").alias("p"), "id"))


@query("d5_dso", f"WITH {_SETS} SELECT l, p, round(shared / (nl + np - shared), 6) AS dso, shared / (nl + np - shared) >= 0.1 AS identified FROM ov", "pts")
def d5(spark, d):
    return E.overlap_criterion(_overlap(spark, d), 0.1).select("l", "p", r6("dso").alias("dso"), "identified")


@query("d6_dswo", f"WITH {_SETS} SELECT l, p, shared / nl >= 0.1 AND shared / np >= 0.2 AS identified FROM ov", "pts")
def d6(spark, d):
    return E.weighted_overlap_criterion(_overlap(spark, d), 0.1, 0.2).select("l", "p", "identified")


@query(
    "a22_coverage_overlap",
    f"WITH {_SETS}, u AS (SELECT DISTINCT id FROM ls), t AS (SELECT id FROM ps WHERE p < 3) SELECT (SELECT count(*) FROM u JOIN t USING (id)) / (SELECT count(*) FROM u) AS coverage, (SELECT count(*) FROM u JOIN t USING (id)) / (SELECT count(*) FROM (SELECT id FROM u UNION SELECT id FROM t)) AS overlap",
    "pts",
)
def a22(spark, d):
    p, lig, pk = _sides(spark, d)
    from orrery.operators.spatial import shell

    u = shell(p.where("not lig"), lig, 4.0).select("id")
    return E.coverage(u, p.where("not lig and grp < 3").select("id"))


# items are customers; their orders are ligands with a rank from the price, -1 for those not found
_IT = """lg AS (SELECT o_custkey AS item, o_orderkey AS l, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) END AS rank,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def _ranks(spark, d):
    o = table(spark, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    n = F.count("*").over(Window.partitionBy("o_custkey"))
    return o.select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("l"), F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(place).alias("rank"), n.alias("n"))


@query(
    "a19_success_rates",
    f"WITH {_IT}, t AS (SELECT unnest([0, 1, 2, 4, 10, 99]) AS tolerance) SELECT CAST(tolerance AS BIGINT) AS tolerance, round(avg(CASE WHEN rank > 0 AND rank <= n + tolerance THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lg, t GROUP BY 1",
)
def a19(spark, d):
    x = E.success_rates(_ranks(spark, d), (0, 1, 2, 4, 10, 99))
    return x.select("tolerance", r6("rate").alias("rate"))


@query(
    "a20_item_success",
    f"WITH {_IT}, t AS (SELECT unnest([0, 2]) AS tolerance) SELECT CAST(tolerance AS BIGINT) AS tolerance, round(sum(CASE WHEN rank > 0 AND rank <= n + tolerance THEN 1.0 / n ELSE 0 END) / count(DISTINCT item), 6) AS rate FROM lg, t GROUP BY 1",
)
def a20(spark, d):
    x = E.item_success_rates(_ranks(spark, d), (0, 2))
    return x.select("tolerance", r6("rate").alias("rate"))


@query(
    "a21_evaluation_stats",
    f"""WITH {_IT}, it AS (SELECT item, max(n) AS n FROM lg GROUP BY 1)
SELECT (SELECT count(*) FROM it) AS n_items, count(*) AS n_ligands, round((SELECT avg(n) FROM it), 6) AS ligands_per_item, round(avg(CASE WHEN rank > 0 THEN rank END), 6) AS avg_rank_found,
  CAST(sum(CAST(rank > 0 AS BIGINT)) AS BIGINT) AS n_found, round(avg(CAST(rank > 0 AS INT)), 6) AS found_rate FROM lg""",
)
def a21(spark, d):
    s = E.evaluation_stats(_ranks(spark, d))
    return s.select("n_items", "n_ligands", r6("ligands_per_item").alias("ligands_per_item"), r6("avg_rank_found").alias("avg_rank_found"), "n_found", r6("found_rate").alias("found_rate"))


@query(
    "a23_top_point_scores",
    """WITH r AS (SELECT grp, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM pts)
SELECT grp, round(avg(score), 6) AS mean, max(score) AS max, round(avg(CASE WHEN k <= 3 THEN score END), 6) AS top3, round(avg(CASE WHEN k <= ceil(n / 2.0) THEN score END), 6) AS top_half FROM r GROUP BY grp""",
    "pts",
)
def a23(spark, d):
    x = E.top_averages(pts(spark, d), "grp", "score", "id")
    return x.select("grp", r6("mean").alias("mean"), "max", r6("top3").alias("top3"), r6("top_half").alias("top_half"))


@query("a24_distinct_average", "SELECT l_suppkey, round(avg(q), 6) AS mean FROM (SELECT DISTINCT l_suppkey, l_partkey, l_partkey % 50 AS q FROM lineitem) GROUP BY 1")
def a24(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_partkey") % 50).alias("q"))
    return A.distinct_average(x, ["l_suppkey"], "l_partkey", "q").withColumn("mean", r6("mean"))


@query("k3_rescored", "SELECT grp, id, old_rank, rank, old_rank - rank AS change, repeat('+', CAST(greatest(old_rank - rank, 0) AS INT)) || repeat('-', CAST(greatest(rank - old_rank, 0) AS INT)) AS bar FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) AS old_rank, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rank FROM pts)", "pts")
def k3(spark, d):
    p = pts(spark, d)
    old = F.row_number().over(Window.partitionBy("grp").orderBy("id")).cast("long")
    new = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "id")).cast("long")
    return E.rescored(p.select("grp", "id", old.alias("old_rank"), new.alias("rank")))


@query("y6_decoy_pockets", "SELECT grp, id, lig FROM (SELECT *, row_number() OVER (PARTITION BY grp, lig ORDER BY score DESC, id) AS n FROM pts) WHERE lig OR n <= 4", "pts")
def y6(spark, d):
    return E.with_decoys(pts(spark, d), ["grp"], "lig", "score", "id", 4).select("grp", "id", "lig")


@query("y10_last_pocket_wins", f"SELECT a.id, max(b.grp) AS pocket FROM pts a JOIN pts b ON NOT a.lig AND b.lig AND {_D2} <= 16 GROUP BY a.id", "pts")
def y10(spark, d):
    p, lig, pk = _sides(spark, d)
    from orrery.operators.spatial import radius_join

    return radius_join(p.where("not lig").select("id", "x", "y", "z"), lig.select("grp", "x", "y", "z"), 4.0).groupBy("id").agg(F.max("grp_r").alias("pocket"))


@query("y12_volume_rescore", "SELECT grp, count(*) * 8 AS volume, row_number() OVER (PARTITION BY grp % 3 ORDER BY count(*) * 8 DESC, grp) AS rank FROM pts WHERE NOT lig GROUP BY grp", "pts")
def y12(spark, d):
    v = E.volumes(pts(spark, d).where("not lig"), ["grp"])
    return W.ranked(v.withColumn("item", F.col("grp") % 3), ["item"], "volume", "grp").select("grp", "volume", F.col("rank").cast("long").alias("rank"))
