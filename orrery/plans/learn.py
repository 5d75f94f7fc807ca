"""Training, cross-validation, importances and parameter grids."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.aggregate import auc
from orrery.operators.sampling import folds
from orrery.session import cut


def values(spec) -> list:
    """Values of a parameter: a list, `(a,b,c)`, or `[min:max:step]` with the ends included."""
    if not isinstance(spec, str):
        return list(spec)
    if m := re.fullmatch(r"\[([^:\]]+):([^:\]]+):([^:\]]+)\]", spec.strip()):
        low, high, step = map(float, m.groups())
        n = int((high - low) / step + 1e-9)
        out = [low + i * step for i in range(n + 1)]
        return [int(v) for v in out] if all(v == int(v) for v in out) and "." not in spec else out
    if m := re.fullmatch(r"\((.*)\)", spec.strip()):
        return [x.strip() for x in m.group(1).split(",")]
    return [spec]


def range_values(spec: Column) -> Column:
    """The values of a column of `[min:max:step]`, ends included, as an array; anything else gives null."""
    pattern = r"^\s*\[([^:\]]+):([^:\]]+):([^:\]]+)\]\s*$"
    low, high, step = (F.regexp_extract(spec, pattern, k).try_cast("double") for k in (1, 2, 3))
    n = F.floor((high - low) / step + 1e-9).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: low + k * step)).when(n < 0, F.array().cast("array<double>"))


def grid(spark: SparkSession, params: dict) -> DataFrame:
    """Cross product of parameter values, the first parameter outermost."""
    rows = list(itertools.product(*(values(v) for v in params.values())))
    return spark.createDataFrame(rows, list(params))


def feature_subsets(names: list[str], mode: str) -> list[list[str]]:
    """Feature sets for ablations: each, pairs, subsets, or leave one out."""
    if mode == "each":
        return [[n] for n in names]
    if mode == "pairs":
        return [list(p) for p in itertools.combinations(names, 2)]
    if mode == "subsets":
        return [list(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]
    if mode == "leave_one_out":
        return [[m for m in names if m != n] for n in names]
    raise ValueError(f"unknown mode: {mode}")


def assembled(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    """features and a numeric label; a NaN or null in a feature is an error."""
    from pyspark.ml.feature import VectorAssembler

    df = df.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def classifier(name: str = "RandomForest", trees: int = 100, depth: int = 0, seed: int = 42, weight: str | None = None):
    """A classifier by name: RandomForest (and its fast variants), Bagging, GBT, LogisticRegression, CostSensitive (needs a weight).
    Boosted and stacked ones are made by ``ensembles``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    extra = {"weightCol": weight} if weight else {}
    if name in ("RandomForest", "FastRandomForest", "FasterForest", "FasterForest2", "CostSensitive"):
        if name == "CostSensitive" and not weight:
            raise ValueError("a cost-sensitive forest needs a weight column")
        return RandomForestClassifier(numTrees=trees, maxDepth=depth or 10, seed=seed, **extra)
    if name == "Bagging":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth or 10, featureSubsetStrategy="all", seed=seed, **extra)
    if name == "GBT":
        return GBTClassifier(maxIter=min(trees, 50), maxDepth=depth or 5, seed=seed, **extra)
    if name in ("Logistic", "SimpleLogistic", "LogisticRegression"):
        return LogisticRegression(**extra)
    raise ValueError(f"unknown classifier: {name}")


def scored(model, df: DataFrame) -> DataFrame:
    """The share of the positive class as column score; negative shares count as 0."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return model.transform(df).withColumn("score", F.greatest(F.try_divide(p[1], p[0] + p[1]), F.lit(0.0)))


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Features by descending importance."""
    found = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def cross_validated(df: DataFrame, columns: list[str], label: str, id_col: str, k: int = 5, seed: int = 42, **kind) -> DataFrame:
    """fold, auc and auprc of each of k folds, trained on the others."""
    from functools import reduce

    data = cut(folds(assembled(df, columns, label), id_col, k, seed))
    out = []
    for n in range(k):
        model = classifier(seed=seed, **kind).fit(data.where(F.col("fold") != n))
        test = scored(model, data.where(F.col("fold") == n)).select((F.col("label") == 1).alias("obs"), "score")
        out.append(auc(test, "obs", "score").select(F.lit(n).alias("fold"), "auc", "auprc"))
    return reduce(DataFrame.unionByName, out)


def seed_loop(df: DataFrame, columns: list[str], label: str, id_col: str, seeds: Iterable[int], k: int = 5, parallel: int = 4, **kind) -> DataFrame:
    """(seed, fold, auc, auprc): a model for each seed and each of k folds, trained on the other folds.

    The folds are dealt once and shared by all seeds. ``parallel`` fits run side by side, each in a
    scheduler pool of its own, so that small stages don't wait for each other.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    spark, seeds = df.sparkSession, list(seeds)
    data = cut(folds(assembled(df, columns, label), id_col, k, seeds[0]))

    def one(task: tuple[int, int, int]):
        n, seed, fold = task
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{n % parallel}")
        model = classifier(seed=seed, **kind).fit(data.where(F.col("fold") != fold))
        test = scored(model, data.where(F.col("fold") == fold)).select((F.col("label") == 1).alias("obs"), "score")
        r = auc(test, "obs", "score").first()
        return seed, fold, r.auc, r.auprc

    tasks = [(n, *x) for n, x in enumerate(itertools.product(seeds, range(k)))]
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), tasks))
    return spark.createDataFrame(rows, "seed int, fold int, auc double, auprc double")


def over_seeds(runs: DataFrame) -> DataFrame:
    """Per figure of a seed loop: mean, sd and rel_sd over all seeds and folds, and the value of each run."""
    from orrery.operators.aggregate import over_runs

    long = runs.select(F.concat_ws("_", "seed", "fold").alias("run"), F.expr("stack(2, 'auc', auc, 'auprc', auprc) AS (name, value)"))
    names = sorted(r.run for r in long.select("run").distinct().collect())
    return over_runs(long, "name", "run", "value", names)


_COLS = ["x", "y", "z", "score"]


def _labelled(points: DataFrame) -> DataFrame:
    return points.withColumn("near", (F.col("x") + F.col("y") > 0).cast("int"))


def demo_forest(points: DataFrame) -> DataFrame:
    data = assembled(_labelled(points), _COLS, "near")
    model = classifier(trees=10, depth=4).fit(data)
    return scored(model, data).select("id", "score")


def demo_importances(points: DataFrame) -> DataFrame:
    data = assembled(_labelled(points), _COLS, "near")
    found = importances(classifier(trees=10, depth=4).fit(data), _COLS)
    return points.sparkSession.createDataFrame(found, "feature string, importance double")


def demo_cross_validation(points: DataFrame) -> DataFrame:
    return cross_validated(_labelled(points), _COLS, "near", "id", k=3, trees=5, depth=3)


def demo_seed_loop(points: DataFrame) -> DataFrame:
    return over_seeds(seed_loop(_labelled(points), _COLS, "near", "id", (1, 2), k=2, trees=4, depth=3))


def demo_boosted(points: DataFrame) -> DataFrame:
    from pyspark.ml.classification import DecisionTreeClassifier

    from orrery.plans.ensembles import boosted

    data = assembled(_labelled(points), _COLS, "near")
    return boosted(data, lambda w: DecisionTreeClassifier(maxDepth=1, weightCol=w), rounds=4).scored(data).select("id", "score")


def demo_stacked(points: DataFrame) -> DataFrame:
    from orrery.plans.ensembles import default_stack, stacked

    data = assembled(_labelled(points), _COLS, "near")
    bases, meta = default_stack(len(_COLS), trees=4, depth=3)
    return stacked(data, bases, meta, "id", k=2).scored(data).select("id", "score")
