"""Boosting, stacking and seed loops against plain loops; running sums and rotations."""

import math
import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from orrery.operators import aggregate as A
from orrery.operators import spatial as S
from orrery.operators import windows as W
from orrery.operators.sampling import folds
from orrery.plans import ensembles, learn

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    at = [(n, r.uniform(-1, 1), r.uniform(-1, 1)) for n in range(120)]
    return [(n, x, y, int(x * x + y * y < 0.4) ^ (n % 15 == 0)) for n, x, y in at]


@pytest.fixture(scope="module")
def data(spark, rows):
    return learn.assembled(spark.createDataFrame(rows, "id long, x double, y double, near int"), COLS, "near")


def stump(w):
    return DecisionTreeClassifier(maxDepth=1, weightCol=w)


def test_boosting_against_a_plain_loop(spark, data, rows):
    weights = {r[0]: 1.0 for r in rows}
    label = {r[0]: r[3] for r in rows}
    margin = dict.fromkeys(label, 0.0)
    models = 0
    for _ in range(5):
        w = spark.createDataFrame(list(weights.items()), "id long, _w double")
        model = stump("_w").fit(data.join(w, "id"))
        said = {r.id: int(r.prediction) for r in model.transform(data).select("id", "prediction").collect()}
        wrong = sum(weights[n] for n in label if said[n] != label[n])
        e = wrong / sum(weights.values())
        if e >= 0.5 or e == 0:
            break
        models += 1
        for n in label:
            margin[n] += math.log((1 - e) / e) * (1 if said[n] else -1)
            weights[n] *= (1 - e) / e if said[n] != label[n] else 1.0
        scale = len(weights) / sum(weights.values())
        weights = {n: v * scale for n, v in weights.items()}
    found = ensembles.boosted(data, stump, rounds=5)
    assert len(found.models) == models > 2
    got = {r.id: r.score for r in found.scored(data).collect()}
    assert all(got[n] == pytest.approx(1 / (1 + math.exp(-margin[n]))) for n in label)
    # many weak classifiers know more than one
    right = lambda s: sum((v > 0.5) == (label[n] == 1) for n, v in s.items())
    one = {r.id: r.score for r in ensembles.boosted(data, stump, rounds=1).scored(data).collect()}
    assert right(got) >= right(one)


def test_boosting_stops_at_once_if_nothing_is_wrong(spark):
    df = learn.assembled(spark.createDataFrame([(n, float(n), 0.0, int(n > 5)) for n in range(12)], "id long, x double, y double, near int"), COLS, "near")
    found = ensembles.boosted(df, stump)
    assert found.votes == [1.0] and {r.id: r.score > 0.5 for r in found.scored(df).collect()} == {n: n > 5 for n in range(12)}


def test_stacking_against_a_plain_loop(spark, data):
    bases = lambda: [DecisionTreeClassifier(maxDepth=3, seed=1), LogisticRegression()]
    meta = lambda: LogisticRegression(featuresCol="_features")
    got = {r.id: r.score for r in ensembles.stacked(data, bases(), meta(), "id", k=3, seed=5).scored(data).collect()}
    # each row is scored by models that haven't seen it
    dealt = folds(data, "id", 3, 5).cache()
    said: dict = {}
    for n in range(3):
        for b, base in enumerate(bases()):
            m = base.fit(dealt.where(F.col("fold") != n))
            said |= {(r.id, b): r.score for r in learn.scored(m, dealt.where(F.col("fold") == n)).collect()}
    out = spark.createDataFrame([(r.id, r.label, [said[r.id, 0], said[r.id, 1]]) for r in data.collect()], "id long, label double, s array<double>")
    from pyspark.ml.functions import array_to_vector

    final = meta().fit(out.withColumn("_features", array_to_vector("s")))
    whole = [base.fit(dealt) for base in bases()]
    scores = {(r.id, b): r.score for b, m in enumerate(whole) for r in learn.scored(m, data).collect()}
    test = spark.createDataFrame([(n, [scores[n, 0], scores[n, 1]]) for n in got], "id long, s array<double>").withColumn("_features", array_to_vector("s"))
    want = {r.id: r.score for r in learn.scored(final, test).collect()}
    assert all(got[n] == pytest.approx(want[n], abs=1e-4) for n in want)


def test_default_stack(data):
    bases, meta = ensembles.default_stack(2, trees=3, depth=3)
    got = ensembles.stacked(data, bases, meta, "id", k=2).scored(data)
    assert got.where("score >= 0 and score <= 1").count() == 120 and set(got.columns) == {*data.columns, "fold", "score"} - {"fold"}


def test_seed_loop(spark, data, rows):
    df = data.drop("features", "label")
    runs = learn.seed_loop(df, COLS, "near", "id", (3, 4, 5), k=2, parallel=3, trees=3, depth=3)
    found = {(r.seed, r.fold): (r.auc, r.auprc) for r in runs.collect()}
    assert found.keys() == {(s, f) for s in (3, 4, 5) for f in (0, 1)}
    # one of them by hand: the folds are those of the first seed
    dealt = folds(data, "id", 2, 3)
    model = learn.classifier(seed=5, trees=3, depth=3).fit(dealt.where("fold <> 1"))
    r = A.auc(learn.scored(model, dealt.where("fold = 1")).select((F.col("label") == 1).alias("obs"), "score"), "obs", "score").first()
    assert found[5, 1] == pytest.approx((r.auc, r.auprc))
    table = {r.name: r for r in learn.over_seeds(runs).collect()}
    values = [v[0] for v in found.values()]
    assert table["auc"].mean == pytest.approx(sum(values) / 6) and table["auc"].run_4_0 == found[4, 0][0] and set(table) == {"auc", "auprc"}


def test_running_sums_over_any_scores(spark):
    r = random.Random(2)
    scores = [r.choice([0.0, 1e-9, 1e12, -5.0, r.uniform(0, 1e-6)]) for _ in range(500)]
    rows = [(s, r.random() < 0.3) for s in scores]
    got = A.score_levels(spark.createDataFrame(rows, "s double, obs boolean").repartition(7), "obs", "s").collect()
    want, tp, fp = [], 0, 0
    for s in sorted(set(scores), reverse=True):
        pos, neg = sum(o for t, o in rows if t == s), sum(not o for t, o in rows if t == s)
        tp, fp = tp + pos, fp + neg
        want.append((s, pos, neg, tp, fp))
    assert sorted(map(tuple, got), reverse=True) == want
    assert A.auc(spark.createDataFrame([], "s double, obs boolean"), "obs", "s").first().auc is None


def test_prefix_sums_spread(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 7).alias("v"))
    out = W.prefix_sums(df.repartition(3), [F.col("id")], {"v": "s"})
    assert out.where(F.spark_partition_id() >= 0).agg(F.max("s")).first()[0] == sum(n % 7 for n in range(10_000))
    assert {r.id: r.s for r in out.where("id in (0, 1, 9, 9999)").collect()} == {k: sum(n % 7 for n in range(k + 1)) for k in (0, 1, 9, 9999)}


def test_random_rotations(spark):
    rows = [(n, i, float(n), 2.0, -1.0) for i in range(300) for n in range(3)]
    points = spark.createDataFrame(rows, "id long, item long, x double, y double, z double")
    out = S.randomly_rotated(points, "item", 2, seed=3)
    got = {(r.item, r.rot, r.id): (r.x, r.y, r.z) for r in out.collect()}
    assert got == {(r.item, r.rot, r.id): (r.x, r.y, r.z) for r in out.repartition(5).collect()}
    for i in range(300):
        for rot in range(3):
            a, b, c = (got[i, rot, n] for n in range(3))
            assert math.hypot(*a) == pytest.approx(math.sqrt(5)) and math.dist(a, c) == pytest.approx(2) and math.dist(a, b) == pytest.approx(1)
        assert got[i, 0, 1] == (1.0, 2.0, -1.0)
    # evenly over all: no direction is preferred
    for k in range(3):
        assert abs(sum(got[i, rot, 0][k] for i in range(300) for rot in (1, 2)) / 600) < 0.2
    assert len({got[i, 1, 0] for i in range(300)}) == 300
