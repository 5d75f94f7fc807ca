"""Operators on small inputs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.api import Predictor
from orrery.functions import features as X
from orrery.functions import strings as Z
from orrery.operators import aggregate as A
from orrery.operators import sampling as M
from orrery.operators import spatial as S
from orrery.operators import transform as R
from orrery.operators.components import components
from orrery.params import Params
from orrery.plans import learn
from orrery.plans.predict import predict_pockets
from orrery.streaming import folder


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in rows], "id long, x double, y double, z double")


def test_radius_is_inclusive(spark):
    a = points(spark, [(1, 0, 0, 0)])
    b = points(spark, [(2, 3, 0, 0), (3, 3.0001, 0, 0), (4, 0, 0, 0), (5, -3, 0, 0)])
    assert {r.id_r for r in S.radius_join(a, b, 3.0).collect()} == {2, 4, 5}
    assert {r.id for r in S.distant(b, a, 3.0).collect()} == {2, 3, 5}
    assert S.shell(b, a.where("id < 0"), 3.0).count() == 0


def test_radius_join_equals_all_pairs(spark):
    rows = [(i, (i * 37) % 23 - 11 + 0.1 * i, (i * 17) % 19 - 9, (i * 11) % 13 - 6) for i in range(120)]
    p = points(spark, rows)
    got = {(r.id, r.id_r) for r in S.radius_join(p, p, 4.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if sum((u - v) ** 2 for u, v in zip(a[1:], b[1:], strict=True)) <= 16}


def test_knn_reaches_far_and_breaks_ties_by_id(spark):
    q = points(spark, [(0, 0, 0, 0)])
    t = points(spark, [(5, 1, 0, 0), (4, -1, 0, 0), (7, 100, 0, 0)])
    assert [(r.id_r, r["rank"]) for r in S.knn(q, t, 3, 0.5).orderBy("rank").collect()] == [(4, 1), (5, 2), (7, 3)]


def test_components_of_a_chain(spark):
    n = spark.range(0, 60)
    e = n.where("id < 49").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    c = {r.id: r.component for r in components(n, e, "id").collect()}
    assert all(c[i] == 0 for i in range(50)) and all(c[i] == i for i in range(50, 60))


def test_pockets_drop_small_clusters(spark):
    rows = [("i", k, float(k), 0.0, 0.0, 0.9) for k in range(4)] + [("i", 10, 50.0, 0.0, 0.0, 0.9), ("i", 11, 6.0, 0.0, 0.0, 0.1)]
    p = spark.createDataFrame(rows, "item string, id long, x double, y double, z double, score double")
    out = predict_pockets(p).collect()
    assert [(r.name, r.n_points, r.score) for r in out] == [("pocket1", 5, round(4 * 0.81 + 0.01, 5))]


def test_thinning_keeps_the_first(spark):
    p = points(spark, [(1, 0, 0, 0), (2, 0.04, 0, 0), (3, 0.08, 0, 0)]).withColumn("item", F.lit("i"))
    assert {r.id for r in S.thinned(p, "item").collect()} == {1, 3}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(False, 0.2), (False, 0.9)], "obs boolean, s double")
    m = A.classifier_metrics(A.confusion(df, "obs", "s", 0.5)).first()
    assert m.r is None and m.p == 0.0 and m.mcc == 1.0
    assert A.auc(df, "obs", "s").first().auc is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "obs boolean, s double")
    r = A.auc(df, "obs", "s").first()
    assert r.auc == 0.875 and abs(r.auprc - (1 + 2 / 3) / 2) < 1e-12


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 9.99, 10.0, 11.0)], "v double")
    assert {r.bin: r.n for r in A.histogram(df, "v", 0.0, 10.0, 10).collect()} == {0: 3, 9: 3}


def test_feature_filters_and_registry():
    cols = ["chem.a", "chem.b", "xyz.x"]
    assert X.filtered(cols, ["-chem.*", "chem.b"]) == ["chem.b", "xyz.x"]
    assert X.filtered(cols, ["chem.*", "-chem.a"]) == ["chem.b"]
    with pytest.raises(ValueError):
        X.register(X.feature("xyz"))
    with pytest.raises(ValueError):
        X.header(["rtype"])
    assert X.header(["xyz"]) == ["xyz.x", "xyz.y", "xyz.z"]


def test_strings(spark):
    df = spark.createDataFrame([("A_T123B",), ("B_7",), ("bad",)], "s string")
    got = [r.r for r in df.select(Z.residue_id(F.col("s")).alias("r")).collect()]
    assert tuple(got[0]) == ("A", "T", 123, "B") and tuple(got[1]) == ("B", None, 7, None) and got[2] is None
    one = spark.createDataFrame([("a/b/x.pdb.gz", "GTP[group_id:B_1173]")], "p string, l string")
    r = one.select(Z.base_name(F.col("p")), Z.real_extension(F.col("p")), Z.is_compressed(F.col("p")), Z.ligand_definition(F.col("l"))).first()
    assert r[0] == "x" and r[1] == "pdb" and r[2] and r[3].name == "GTP" and r[3].group_id == "B_1173" and r[3].atom_id is None


def test_params_and_grids():
    p = Params()
    assert p.sas_cutoff == 4.1 and p.rescoring().residue_score_extra_dist == 2.0
    assert p.with_json(json.dumps({"folds": 3})).folds == 3
    with pytest.raises(ValueError):
        p.with_json('{"nope": 1}')
    assert learn.values("[0:1:0.5]") == [0.0, 0.5, 1.0] and learn.values("(a,b)") == ["a", "b"]
    assert learn.feature_subsets(["a", "b", "c"], "leave_one_out") == [["b", "c"], ["a", "c"], ["a", "b"]]
    assert R.from_json(R.to_json("z", {"mean": 1.0})) == ("z", {"mean": 1.0})


def test_exact_folds_are_even(spark):
    n = {r.fold: r["count"] for r in M.exact_folds(spark.range(103), "id", 5).groupBy("fold").count().collect()}
    assert sorted(n.values()) == [20, 20, 21, 21, 21]


def test_predictor_learns(spark, tmp_path):
    rows = [("i", k, float(k % 20), float(k // 20), 0.0, int(k % 20 < 8)) for k in range(200)]
    p = spark.createDataFrame(rows, "item string, id long, x double, y double, z double, label int")
    model = Predictor.train(p, ["x", "y"], "label", trees=10, depth=4)
    found = model.predict(p)
    assert found.orderBy("rank").first().x < 10
    model.save(str(tmp_path / "m"))
    assert Predictor.load(str(tmp_path / "m"), ["x", "y"]).score(p).where("score > 0.5").count() == 80


def test_stream_predicts_each_arrival(spark, tmp_path):
    rows = [("i", k, float(k), 0.0, 0.0, 0.9) for k in range(4)]
    spark.createDataFrame(rows, "item string, id long, x double, y double, z double, score double").write.parquet(str(tmp_path / "in"))
    q = folder.for_each_arrival(folder.points_stream(spark, str(tmp_path / "in")), predict_pockets, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
