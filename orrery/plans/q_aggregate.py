"""Queries over predictions: classifier counts, metrics, curves, histograms, transformers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import aggregate as A
from orrery.operators import transform as X
from orrery.plans.registry import pred, pts, query, r6
from orrery.session import table

_COUNTS = """SELECT sum(CAST(obs AND s >= 0.5 AS BIGINT)) AS tp, sum(CAST(NOT obs AND s >= 0.5 AS BIGINT)) AS fp,
  sum(CAST(NOT obs AND s < 0.5 AS BIGINT)) AS tn, sum(CAST(obs AND s < 0.5 AS BIGINT)) AS fn,
  sum(abs(CAST(obs AS INT) - s)) AS sum_e, sum(CASE WHEN obs THEN abs(1 - s) ELSE 0 END) AS sum_e_pos, sum(CASE WHEN NOT obs THEN s ELSE 0 END) AS sum_e_neg,
  sum(pow(CAST(obs AS INT) - s, 2)) AS sum_se, sum(CASE WHEN obs THEN pow(1 - s, 2) ELSE 0 END) AS sum_se_pos, sum(CASE WHEN NOT obs THEN s * s ELSE 0 END) AS sum_se_neg FROM pred"""
_C = "WITH c0 AS (" + _COUNTS + "), c AS (SELECT " + ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in ("tp", "fp", "tn", "fn", "sum_e", "sum_e_pos", "sum_e_neg", "sum_se", "sum_se_pos", "sum_se_neg")) + " FROM c0)"


@query(
    "a7_confusion",
    "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, "
    + ", ".join(f"round({k}, 3) AS {k}" for k in ("sum_e", "sum_e_pos", "sum_e_neg", "sum_se", "sum_se_pos", "sum_se_neg"))
    + f" FROM ({_COUNTS})",
    "pred",
)
def a7(spark, d):
    c = A.confusion(pred(spark, d), "obs", "s", 0.5)
    return c.select("tp", "fp", "tn", "fn", *(r6(k, 3).alias(k) for k in c.columns if k.startswith("sum")))


_P, _R, _SPC, _NPV = "tp/nullif(tp+fp,0)", "tp/nullif(tp+fn,0)", "tn/nullif(tn+fp,0)", "tn/nullif(tn+fn,0)"
_FPR, _FNR = "fp/nullif(fp+tn,0)", "fn/nullif(tp+fn,0)"
_MCC_DEN = "sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))"
_METRICS = {
    "p": _P, "r": _R, "f1": f"2*({_P})*({_R})/nullif({_P}+{_R},0)", "f2": f"5*({_P})*({_R})/nullif(4*({_P})+{_R},0)", "f05": f"1.25*({_P})*({_R})/nullif(0.25*({_P})+{_R},0)",
    "mcc": f"CASE WHEN {_MCC_DEN} = 0 THEN 1 ELSE (tp*tn-fp*fn)/{_MCC_DEN} END", "npv": _NPV, "spc": _SPC, "acc": "(tp+tn)/(tp+fp+tn+fn)", "bacc": f"({_R}+{_SPC})/2",
    "tpx": "tp/nullif(tp+fn+fp,0)", "fpr": _FPR, "fnr": _FNR, "plr": f"({_R})/nullif({_FPR},0)", "nlr": f"({_FNR})/nullif({_SPC},0)",
    "dor": f"(({_R})/nullif({_FPR},0))/nullif(({_FNR})/nullif({_SPC},0),0)", "fdr": "fp/nullif(fp+tp,0)", "fom": "fn/nullif(fn+tn,0)", "yjs": f"{_R}+{_SPC}-1", "mrk": f"{_P}+{_NPV}-1",
    "me": "sum_e/(tp+fp+tn+fn)", "me_pos": "sum_e_pos/(tp+fp+tn+fn)", "me_neg": "sum_e_neg/(tp+fp+tn+fn)", "mse": "sum_se/(tp+fp+tn+fn)", "mse_pos": "sum_se_pos/(tp+fp+tn+fn)", "mse_neg": "sum_se_neg/(tp+fp+tn+fn)",
}


@query("x9_classifier_metrics", _C + " SELECT " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _METRICS.items()) + " FROM c", "pred")
def x9(spark, d):
    m = A.classifier_metrics(A.confusion(pred(spark, d), "obs", "s", 0.5))
    return m.select(*(r6(k).alias(k) for k in _METRICS))


@query("a8_partial_merge", "SELECT l_returnflag AS f, count(*) AS n, round(sum(l_discount), 4) AS total FROM lineitem GROUP BY 1")
def a8(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_discount").alias("total"))
    return A.merged(parts, ["f"], ["n", "total"]).withColumn("total", r6("total", 4))


@query(
    "a9_histogram",
    """SELECT CAST(CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity >= 45 THEN 19 ELSE least(greatest(floor((l_quantity - 5) / 2.0), 0), 19) END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1""",
)
def a9(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 5.0, 45.0, 20)


_LEVELS = "lv AS (SELECT s, sum(CAST(obs AS BIGINT)) AS pos, sum(CAST(NOT obs AS BIGINT)) AS neg FROM pred GROUP BY s), cum AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM lv)"


@query(
    "a11_auc_auprc",
    f"""WITH {_LEVELS} SELECT round(1 - sum(pos * (fp - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS auprc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum""",
    "pred",
)
def a11(spark, d):
    return A.auc(pred(spark, d), "obs", "s").select(r6("auc").alias("auc"), r6("auprc").alias("auprc"), "n_pos", "n_neg")


@query("a12_log_loss", "SELECT round(avg(-ln(greatest(CASE WHEN obs THEN s ELSE 1 - s END, 0.01))), 6) AS log_loss FROM pred", "pred")
def a12(spark, d):
    return pred(spark, d).agg(r6(A.log_loss(F.col("obs"), F.col("s"))).alias("log_loss"))


@query("a13_moments", "SELECT l_returnflag AS f, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis FROM lineitem GROUP BY 1")
def a13(spark, d):
    m = A.moments(table(spark, d, "lineitem").withColumn("f", F.col("l_returnflag")), "l_quantity", ("f",))
    return m.select("f", "n", *(r6(c).alias(c) for c in ("mean", "variance", "skewness", "kurtosis")))


@query("a14_mean_scores", "SELECT round(avg(s), 6) AS mean_score, round(avg(CASE WHEN obs THEN s END), 6) AS mean_pos FROM pred", "pred")
def a14(spark, d):
    return A.mean_scores(pred(spark, d), "obs", "s").select(*(r6(c).alias(c) for c in ("mean_score", "mean_pos")))


@query("a15_roc_curve", f"WITH {_LEVELS} SELECT s, round(tp / sum(pos) OVER (), 6) AS tpr, round(fp / sum(neg) OVER (), 6) AS fpr FROM cum", "pred")
def a15(spark, d):
    v = A.score_levels(pred(spark, d), "obs", "s")
    total = v.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return v.crossJoin(F.broadcast(total)).select("s", r6(A.ratio(F.col("tp"), F.col("p"))).alias("tpr"), r6(A.ratio(F.col("fp"), F.col("n"))).alias("fpr"))


@query(
    "a16_sample_statistics",
    """SELECT round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 1) AS var, round(stddev_samp(o_totalprice), 4) AS sd,
  round(100.0 * stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS rel_sd, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""",
)
def a16(spark, d):
    s = table(spark, d, "orders").agg(*A.sample_stats(F.col("o_totalprice")))
    return s.select(r6("sum", 2).alias("sum"), r6("mean", 4).alias("mean"), r6("var", 1).alias("var"), r6("sd", 4).alias("sd"), r6("rel_sd").alias("rel_sd"), "min", "max")


_PAIR = """pair AS (SELECT a.grp, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM pts a JOIN pts b ON a.grp = b.grp AND a.id <= b.id)"""
_SMOOTH = """placed AS (SELECT grp, pos, least(CAST(floor(pos) AS BIGINT), 8) AS b FROM (SELECT grp, least(greatest((dist - 1) / (5.0::DOUBLE / 9), 0), 9) AS pos FROM pair)),
two AS (SELECT grp, b AS bin, 1 - (pos - b) AS share FROM placed UNION ALL SELECT grp, b + 1, pos - b FROM placed)"""


@query(
    "a27_pair_histogram_hard",
    f"WITH {_PAIR} SELECT grp, CAST(CASE WHEN dist <= 0 THEN 0 WHEN dist >= 6 THEN 9 ELSE floor(dist / 0.6) END AS BIGINT) AS bin, count(*)::DOUBLE AS n FROM pair GROUP BY 1, 2",
    "pts",
)
def a27(spark, d):
    return A.pair_distances(pts(spark, d), "grp", 0.0, 6.0, 10)


@query("a27_pair_histogram_smooth", f"WITH {_PAIR}, {_SMOOTH} SELECT grp, bin, round(sum(share), 5) AS n FROM two GROUP BY 1, 2 HAVING sum(share) > 0", "pts")
def a27s(spark, d):
    return A.pair_distances(pts(spark, d), "grp", 1.0, 6.0, 10, smooth=True).select("grp", "bin", r6("n", 5).alias("n"))


@query(
    "a27_pair_histogram_normalised",
    f"WITH {_PAIR}, {_SMOOTH}, c AS (SELECT grp, count(*) AS c FROM pair GROUP BY 1) SELECT grp, bin, round(sum(share) / any_value(c), 7) AS n FROM two JOIN c USING (grp) GROUP BY 1, 2 HAVING sum(share) > 0",
    "pts",
)
def a27n(spark, d):
    return A.pair_distances(pts(spark, d), "grp", 1.0, 6.0, 10, smooth=True, normalised=True).select("grp", "bin", r6("n", 7).alias("n"))


@query("a28_zscore_training", "SELECT round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS stdev FROM pred WHERE obs", "pred")
def a28(spark, d):
    z = X.zscore_fit(pred(spark, d), "obs", "s")
    return z.select(r6("mean").alias("mean"), r6("stdev").alias("stdev"))


_BINS = """bins AS (SELECT CAST(CASE WHEN s <= 0 THEN 0 WHEN s >= 1 THEN 9 ELSE floor(s / 0.1) END AS BIGINT) AS bin, obs FROM pred),
byb AS (SELECT r.bin, coalesce(sum(CAST(obs AS BIGINT)), 0) AS t, coalesce(sum(CAST(NOT obs AS BIGINT)), 0) AS f FROM (SELECT range AS bin FROM range(10)) r LEFT JOIN bins USING (bin) GROUP BY 1),
cum AS (SELECT bin, sum(t) OVER (ORDER BY bin) AS tp, sum(f) OVER (ORDER BY bin DESC) AS fp FROM byb)"""


@query("a28_probability_training", f"WITH {_BINS} SELECT bin, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum", "pred")
def a28p(spark, d):
    return X.probability_fit(pred(spark, d), "obs", "s", 0.0, 1.0, 10)


@query(
    "a29_probability_transform",
    f"""WITH {_BINS}, q AS (SELECT id, (score * 2 - 0.25) / 0.1 AS pos FROM pts), i AS (SELECT id, pos, CAST(least(greatest(trunc(pos), 0), 9) AS BIGINT) AS idx FROM q),
lo AS (SELECT i.id, pos - idx AS w, a.tp AS t0, a.fp AS f0, coalesce(b.tp, a.tp) AS t1, coalesce(b.fp, a.fp) AS f1
  FROM i JOIN cum a ON a.bin = idx LEFT JOIN cum b ON b.bin = idx + 1)
SELECT id, round(greatest((t0 + w * (t1 - t0)) / nullif((t0 + w * (t1 - t0)) + (f0 + w * (f1 - f0)), 0), 0), 6) AS probability FROM lo""",
    "pred",
    "pts",
)
def a29(spark, d):
    fit = X.probability_fit(pred(spark, d), "obs", "s", 0.0, 1.0, 10)
    # some scores lie beyond the trained ones
    scores = pts(spark, d).select("id", (F.col("score") * 2 - 0.25).alias("score"))
    out = X.probability(scores, "score", fit, 0.0, 1.0, 10)
    return out.select("id", r6("probability").alias("probability"))


@query("a3_pocket_score", "SELECT grp, round(sum(s), 5) AS score FROM (SELECT grp, pow(score, 2) AS s, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS n FROM pts) WHERE n <= 5 GROUP BY grp", "pts")
def a3(spark, d):
    return A.pocket_scores(pts(spark, d), ["grp"], limit=5).select("grp", r6("pocket_score", 5).alias("score"))


@query("a4_rescoring", "SELECT grp, round(sum(pow(greatest(score, 0), 2)), 5) AS raw_score, round(avg(score), 6) AS mean_score, count(*) AS n FROM pts GROUP BY grp", "pts")
def a4(spark, d):
    return A.pocket_scores(pts(spark, d), ["grp"]).select("grp", r6("pocket_score", 5).alias("raw_score"), r6("mean_score").alias("mean_score"), "n")


@query(
    "a5_residue_score",
    """SELECT a.id, round(coalesce(sum(pow(b.score, 2)) / pow(count(b.id), 0.5), 0), 5) AS score FROM pts a LEFT JOIN pts b
  ON b.lig AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 6.1*6.1 WHERE NOT a.lig GROUP BY a.id""",
    "pts",
)
def a5(spark, d):
    p = pts(spark, d)
    return X.residue_scores(p.where("not lig").select("id", "x", "y", "z"), p.where("lig").select("x", "y", "z", "score"), 6.1, 2.0, 0.5).select("id", r6("score", 5).alias("score"))


@query("a6_propensity_zscore", "SELECT grp, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 6) AS z FROM (SELECT grp, sum(score) AS s FROM pts GROUP BY grp)", "pts")
def a6(spark, d):
    g = pts(spark, d).groupBy("grp").agg(F.sum("score").alias("s"))
    return A.standardised(g, "s").select("grp", r6("z").alias("z"))


@query(
    "a25_multi_run",
    """WITH runs AS (SELECT o_orderkey % 5 AS run, o_orderstatus AS stat, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT stat, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(100 * stddev_samp(v) / avg(v), 6) AS rel_sd, """
    + ", ".join(f"round(max(CASE WHEN run = {i} THEN v END), 4) AS run_{i}" for i in range(5))
    + " FROM runs GROUP BY stat",
)
def a25(spark, d):
    runs = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("run"), F.col("o_orderstatus").alias("stat")).agg(F.avg("o_totalprice").alias("v"))
    x = A.over_runs(runs, "stat", "run", "v", list(range(5)))
    return x.select("stat", *(r6(c, 6 if c == "rel_sd" else 4).alias(c) for c in x.columns if c != "stat"))


@query(
    "k13_pivot",
    "SELECT o_orderpriority AS priority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 4) AS {s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1",
)
def k13(spark, d):
    p = A.parameter_table(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return p.select("priority", *(r6(s, 4).alias(s.lower()) for s in "FOP"))


@query("a26_label_stats", "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg, count(*) - count(toxic) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def a26(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return A.label_stats(j.withColumn("label", F.col("toxic") == 1), "label")
