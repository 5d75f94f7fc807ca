"""Queries over ordered rows: ranks, neighbours, runs, pairs; folds and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import sampling as M
from orrery.operators import windows as W
from orrery.plans.registry import CHAIN_ORDER, chain, pts, query, r6
from orrery.session import table

_OV = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("w1_pocket_rank", "SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rank FROM pts", "pts")
def w1(spark, d):
    return W.ranked(pts(spark, d), ["grp"], "score", "id").select("grp", "id", F.col("rank").cast("long").alias("rank"))


@query("w2_inverse_rank", "SELECT grp, id, count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY id) + 1 AS score FROM pts", "pts")
def w2(spark, d):
    return W.inverse_rank(pts(spark, d).drop("score"), ["grp"], ["id"]).select("grp", "id", "score")


@query(
    "w3_head_reordered",
    """SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN place <= 5 THEN -score END ASC NULLS LAST, place) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS place FROM pts)""",
    "pts",
)
def w3(spark, d):
    return W.head_reordered(pts(spark, d), ["grp"], ["id"], "score", 5).select("grp", "id", F.col("rank").cast("long").alias("rank"))


@query("w4_prev_next", f"SELECT user_id, event_id, lag(t) OVER {_OV} AS prev, lead(t) OVER {_OV} AS next FROM chain", "chain")
def w4(spark, d):
    return W.neighbours(chain(spark, d), ["user_id"], CHAIN_ORDER, "t").select("user_id", "event_id", "prev", "next")


_ISL = f"""turns AS (SELECT *, CASE WHEN lag(t) OVER {_OV} = t THEN 0 ELSE 1 END AS turn FROM chain),
secs AS (SELECT *, CAST(sum(turn) OVER {_OV} AS BIGINT) AS section FROM turns)"""


@query(
    "w5_sections",
    f"""WITH {_ISL} SELECT user_id, event_id, section, row_number() OVER (PARTITION BY user_id, section ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id, section) AS length,
  round(row_number() OVER (PARTITION BY user_id, section ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id, section), 6) AS rel_pos FROM secs""",
    "chain",
)
def w5(spark, d):
    x = W.islands(chain(spark, d), ["user_id"], CHAIN_ORDER, "t")
    return x.select("user_id", "event_id", "section", "pos", "length", r6("rel_pos").alias("rel_pos"))


@query(
    "w6_nearest_different_section",
    f"""WITH {_ISL}, one AS (SELECT user_id, section, min(t) AS t FROM secs GROUP BY 1, 2)
SELECT user_id, section, t, lag(t) OVER (PARTITION BY user_id ORDER BY section) AS prev_type, lead(t) OVER (PARTITION BY user_id ORDER BY section) AS next_type FROM one""",
    "chain",
)
def w6(spark, d):
    x = W.sections(W.islands(chain(spark, d), ["user_id"], CHAIN_ORDER, "t"), ["user_id"], "t")
    return x.select("user_id", "section", "t", "prev_type", "next_type")


_NB = f"nb AS (SELECT letter AS a, coalesce(lag(letter) OVER {_OV}, '_') AS p, coalesce(lead(letter) OVER {_OV}, '_') AS n FROM chain)"


@query(
    "w7_duplets",
    f"""WITH {_NB}, dup AS (SELECT CASE WHEN a <= p THEN a || p ELSE p || a END AS duplet FROM nb UNION ALL SELECT CASE WHEN a <= n THEN a || n ELSE n || a END FROM nb)
SELECT duplet, count(*) AS n FROM dup GROUP BY 1""",
    "chain",
)
def w7d(spark, d):
    return W.duplets(chain(spark, d), ["user_id"], CHAIN_ORDER, "letter").groupBy("duplet").agg(F.count("*").alias("n"))


@query("w7_triplets", f"WITH {_NB} SELECT CASE WHEN p <= n THEN p || a || n ELSE n || a || p END AS triplet, count(*) AS n FROM nb GROUP BY 1", "chain")
def w7t(spark, d):
    return W.triplets(chain(spark, d), ["user_id"], CHAIN_ORDER, "letter").groupBy("triplet").agg(F.count("*").alias("n"))


@query("w8_combined_rank", "SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY round(pow(score, 1.5) * (id % 7), 9) DESC, id) AS rank FROM pts", "pts")
def w8(spark, d):
    p = pts(spark, d).withColumn("c", F.round(F.pow("score", F.lit(1.5)) * (F.col("id") % 7), 9))
    return W.ranked(p, ["grp"], "c", "id").select("id", "grp", F.col("rank").cast("long").alias("rank"))


@query("w9_reference_label", "SELECT c.c_custkey AS k, coalesce(min(o.o_orderkey % 9 + 1), 0) AS pocket FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def w9(spark, d):
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.col("o_orderkey") % 9 + 1).alias("p"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(best, "k", "left").select("k", F.coalesce("p", F.lit(0)).alias("pocket"))


for _n, _last, _dir in (("w10_head", False, "ASC"), ("w10_tail_reversed", True, "DESC")):
    query(_n, f"SELECT grp, id, place FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id {_dir}) AS place FROM pts) WHERE place <= 3", "pts")(
        lambda spark, d, last=_last: W.first_or_last(pts(spark, d), ["grp"], ["id"], 3, last).select("grp", "id", "place")
    )


@query("w11_deterministic_order", "SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey) AS n FROM part")
def w11(spark, d):
    return W.ordered(table(spark, d, "part"), ["p_brand"], ["p_size", "p_name", "p_partkey"]).select("p_brand", "p_name", "p_partkey", "n")


@query("w13_best_so_far", f"SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM chain", "chain")
def w13(spark, d):
    return W.running_max(chain(spark, d), ["user_id"], CHAIN_ORDER, "value").select("user_id", "event_id", "best")


@query("w14_cumulative_sum", f"SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM chain", "chain")
def w14(spark, d):
    return W.running_sum(chain(spark, d), ["user_id"], CHAIN_ORDER, "value").select("user_id", "event_id", r6("cumulative", 4).alias("cumulative"))


@query("a17_propensity_counter", "SELECT t, count(*) FILTER (value >= 50) AS pos, count(*) FILTER (value < 50) AS neg, count(*) AS count, round(avg(CAST(value >= 50 AS INT)), 6) AS ratio FROM chain GROUP BY t", "chain")
def a17(spark, d):
    x = W.propensities(chain(spark, d), "t", F.col("value") >= 50)
    return x.select("t", "pos", "neg", "count", r6("ratio").alias("ratio"))


@query(
    "a18_labelled_propensities",
    """SELECT lang, CAST(sum(toxic) AS BIGINT) AS pos, CAST(sum(1 - toxic) AS BIGINT) AS neg, count(*) AS count, round(avg(toxic), 6) AS ratio
FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY lang""",
)
def a18(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    x = W.propensities(j, "lang", F.col("toxic") == 1)
    return x.select("lang", "pos", "neg", "count", r6("ratio").alias("ratio"))


@query("m1_folds", "SELECT o_orderkey, ((o_orderkey + 42) * 7919 % 10007) % 5 AS fold FROM orders")
def m1(spark, d):
    return M.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("m1_exact_folds", "SELECT o_orderkey, (row_number() OVER (ORDER BY (o_orderkey + 42) * 7919 % 10007, o_orderkey) - 1) % 5 AS fold FROM orders")
def m1e(spark, d):
    return M.exact_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("m2_random_subset", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey + 42) * 7919 % 10007, o_orderkey LIMIT 100")
def m2(spark, d):
    return M.subset(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("m3_train_share", "SELECT o_orderkey FROM orders WHERE (o_orderkey + 42) * 7919 % 10007 < 0.3 * 10007")
def m3(spark, d):
    return M.share(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query(
    "m4_rebalanced",
    """WITH c AS (SELECT sum(CAST(o_orderstatus = 'F' AS BIGINT)) AS p, sum(CAST(o_orderstatus <> 'F' AS BIGINT)) AS n FROM orders), r AS (SELECT 2.5 * n / p AS ratio FROM c),
e AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(ratio) AS INT) + CASE WHEN (o_orderkey + 42) * 7919 % 10007 < (ratio - floor(ratio)) * 10007 THEN 1 ELSE 0 END ELSE 1 END AS copies FROM orders, r)
SELECT o_orderkey, CAST(unnest(range(copies)) AS INT) AS copy FROM e""",
)
def m4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("pos"))
    return M.balanced(o, "o_orderkey", "pos", 2.5).select("o_orderkey", "copy")


@query(
    "m5_class_weights",
    "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 0.5 / (SELECT sum(CAST(o_orderstatus = 'F' AS INT)) / sum(CAST(o_orderstatus <> 'F' AS INT)) FROM orders) ELSE 1 END, 6) AS weight FROM orders",
)
def m5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("pos"))
    return M.class_weights(o, "pos", 0.5).select("o_orderkey", r6("weight").alias("weight"))


@query("m9_hash_order", "SELECT id, row_number() OVER (PARTITION BY grp ORDER BY (id + 42) * 7919 % 10007, id) AS rank FROM pts", "pts")
def m9(spark, d):
    w = Window.partitionBy("grp").orderBy(M.hashed("id"), "id")
    return pts(spark, d).select("id", F.row_number().over(w).cast("long").alias("rank"))
