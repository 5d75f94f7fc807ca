"""Embedding API: train a model on labelled points and predict pockets for new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orrery.params import Params
from orrery.plans import learn
from orrery.plans.predict import predict_pockets


class Predictor:
    """A fitted classifier with the parameters it predicts under.

    points: item, id, x, y, z and the feature columns.
    """

    def __init__(self, model, columns: list[str], params: Params | None = None):
        self.model, self.columns, self.params = model, list(columns), params or Params()

    @classmethod
    def train(cls, points: DataFrame, columns: list[str], label: str, params: Params | None = None, **kind) -> "Predictor":
        params = params or Params()
        data = learn.assembled(points, columns, label)
        return cls(learn.classifier(seed=params.seed, **kind).fit(data), columns, params)

    def score(self, points: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return learn.scored(self.model, VectorAssembler(inputCols=self.columns, outputCol="features", handleInvalid="error").transform(points))

    def predict(self, points: DataFrame) -> DataFrame:
        """Ranked pockets of each item."""
        return self.pockets(self.score(points).select("item", "id", "x", "y", "z", "score"))

    def pockets(self, scored: DataFrame) -> DataFrame:
        """Ranked pockets of each item, from points with their scores."""
        return predict_pockets(scored, self.params)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, columns: list[str], params: Params | None = None) -> "Predictor":
        from pyspark.ml.classification import RandomForestClassificationModel

        return cls(RandomForestClassificationModel.load(path), columns, params)
