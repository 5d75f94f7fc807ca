"""Score transformers and residue scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.aggregate import fixed_bin
from orrery.operators.spatial import radius_join


def zscore_fit(df: DataFrame, observed: str, score: str) -> DataFrame:
    """One row: mean and sample deviation of the scores of true pockets."""
    return df.where(observed).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("stdev"))


def zscore(df: DataFrame, score: str, mean: float, stdev: float) -> DataFrame:
    return df.withColumn("zscore", (F.col(score) - mean) / stdev)


def probability_fit(df: DataFrame, observed: str, score: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, tp, fp): true positives up to a bin and false positives from a bin on. One row per bin."""
    n = df.groupBy(fixed_bin(F.col(score), low, high, bins).alias("bin")).agg(F.count_if(F.col(observed)).alias("t"), F.count_if(~F.col(observed)).alias("f"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(n, "bin", "left").na.fill(0)
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return every.select("bin", F.sum("t").over(up).alias("tp"), F.sum("f").over(down).alias("fp"))


def probability(df: DataFrame, score: str, fit: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """tp / (tp + fp), both interpolated from a bin's lower edge to the next one's, and constant from the
    last bin on; below the first bin its line goes on, and a share below 0 is 0."""
    width = (high - low) / bins
    at = df.withColumn("_pos", (F.col(score) - low) / width)
    # a position is cut towards zero before it is kept within the bins
    at = at.withColumn("bin", F.least(F.greatest(F.col("_pos").cast("long"), F.lit(0)), F.lit(bins - 1)).cast("long")).withColumn("_w", F.col("_pos") - F.col("bin"))
    nxt = fit.select((F.col("bin") - 1).alias("bin"), F.col("tp").alias("_t1"), F.col("fp").alias("_f1"))
    # one row per bin
    both = F.broadcast(fit.join(nxt, "bin", "left"))
    x = at.join(both, "bin")
    tp = F.col("tp") + F.col("_w") * (F.coalesce("_t1", "tp") - F.col("tp"))
    fp = F.col("fp") + F.col("_w") * (F.coalesce("_f1", "fp") - F.col("fp"))
    return x.withColumn("probability", F.greatest(F.try_divide(tp, tp + fp), F.lit(0.0))).select(*df.columns, "probability")


def to_json(name: str, params: dict) -> str:
    """A fitted transformer as text: {name, params}."""
    return json.dumps({"name": name, "params": params})


def from_json(text: str) -> tuple[str, dict]:
    d = json.loads(text)
    return d["name"], d["params"]


def sigmoid01(x):
    return 2.0 / (F.exp(-x) + 1.0) - 1.0


def squash(x):
    """2 * atan(x) / pi."""
    return 2.0 * F.atan(x) / 3.141592653589793


def residue_scores(residues: DataFrame, points: DataFrame, r: float, power: float = 2.0, count_power: float = 0.0, limit: int = 0) -> DataFrame:
    """Per residue point: sum of the transformed scores of the points within r over n ** count_power; no point, 0."""
    near = radius_join(residues, points, r)
    if limit:
        best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score_r")))
        near = near.withColumn("_n", best).where(F.col("_n") <= limit)
    s = F.sum(F.pow(F.greatest("score_r", F.lit(0.0)), F.lit(power))) / F.pow(F.count("*").cast("double"), F.lit(count_power))
    got = near.groupBy("id").agg(s.alias("score"))
    return residues.select("id").join(got, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
