"""Classifiers made of classifiers: boosting by reweighting, and stacking on out-of-fold predictions.

Both keep one table: boosting hands it from round to round with new weights and stacking deals it into
folds once. Rows stay where they are; only models and single rows of sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.sampling import folds
from orrery.plans.learn import scored
from orrery.session import cut

_OWN = ("rawPrediction", "probability", "prediction", "score")


class Boosted:
    """Classifiers that vote with a weight each; the score is the positive votes' share on the scale of exponents."""

    def __init__(self, models: Sequence, votes: Sequence[float]):
        self.models, self.votes = list(models), list(votes)

    def scored(self, df: DataFrame) -> DataFrame:
        sides: list[Column] = []
        for n, m in enumerate(self.models):
            df = m.transform(df).withColumn(f"_p{n}", F.col("prediction")).drop(*_OWN)
            sides.append(F.when(F.col(f"_p{n}") > 0.5, self.votes[n]).otherwise(-self.votes[n]))
        margin = reduce(lambda a, b: a + b, sides)
        return df.withColumn("score", 1 / (1 + F.exp(-margin))).drop(*(f"_p{n}" for n in range(len(self.models))))


def boosted(data: DataFrame, base: Callable[[str], object], rounds: int = 10) -> Boosted:
    """AdaBoost.M1 over rows with features and label (0 or 1).

    base: a classifier for the name of a weight column. Each round fits all rows, weighs its error e, gives the
    model ln((1 - e) / e) votes and multiplies the weights of the rows that it got wrong by (1 - e) / e, scaled
    to the number of rows. It ends before a model that is wrong on half of the weight, or with nothing
    wrong; the first model stays in any case.
    """
    now = cut(data.withColumn("_w", F.lit(1.0)))
    models, votes = [], []
    for n in range(rounds):
        model = base("_w").fit(now)
        seen = model.transform(now).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double")).drop(*_OWN)
        seen = cut(seen)
        total, wrong, rows = seen.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_miss")), F.count("*")).first()
        e = (wrong or 0.0) / total if total else 0.0
        if e >= 0.5 or e == 0:
            if n == 0:
                models, votes = [model], [1.0]
            break
        odds = (1 - e) / e
        models.append(model)
        votes.append(math.log(odds))
        scale = rows / (total - wrong + wrong * odds)
        now = seen.withColumn("_w", F.col("_w") * F.when(F.col("_miss") == 1, odds).otherwise(1.0) * scale).drop("_miss")
    return Boosted(models, votes)


class Stacked:
    """Classifiers whose scores are the features of another one."""

    def __init__(self, bases: Sequence, meta):
        self.bases, self.meta = list(bases), meta

    def scored(self, df: DataFrame) -> DataFrame:
        names = [f"_s{n}" for n in range(len(self.bases))]
        return scored(self.meta, _on_scores(_with_scores(df, self.bases), names)).drop("rawPrediction", "probability", "prediction", "_features", *names)


def _with_scores(df: DataFrame, models: Sequence) -> DataFrame:
    for n, m in enumerate(models):
        df = scored(m, df).withColumn(f"_s{n}", F.col("score")).drop(*_OWN)
    return df


def _on_scores(df: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(F.array(*names)))


def stacked(data: DataFrame, bases: Sequence, meta, id_col: str, k: int = 5, seed: int = 42) -> Stacked:
    """Stacking: the meta classifier learns from what the bases, fitted on the other folds, say of each
    row; the bases are then fitted on all rows.

    meta reads its features from the column ``_features``. Each fold is scored by its own models and
    keeps its columns, so nothing is joined.
    """
    dealt = cut(folds(data, id_col, k, seed))
    parts = [_with_scores(dealt.where(F.col("fold") == n), [b.fit(dealt.where(F.col("fold") != n)) for b in bases]) for n in range(k)]
    out = cut(reduce(DataFrame.unionByName, parts))
    names = [f"_s{n}" for n in range(len(bases))]
    return Stacked([b.fit(dealt) for b in bases], meta.fit(_on_scores(out, names)))


def default_stack(features: int, trees: int = 100, depth: int = 10, seed: int = 42) -> tuple[list, object]:
    """Logistic regression, a forest and a perceptron with one hidden layer, below a logistic regression."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    net = MultilayerPerceptronClassifier(layers=[features, (features + 2) // 2, 2], seed=seed)
    return [LogisticRegression(), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed), net], LogisticRegression(featuresCol="_features")
