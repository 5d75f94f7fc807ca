"""Aggregations: distance-weighted features, histograms, classifier counts and curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.spatial import XYZ, close_pairs, near
from orrery.operators.windows import prefix_sums


def weighted_features(
    points: DataFrame, atoms: DataFrame, values: list[str], r: float, weight: Callable[[Column], Column], avg_pow: float = 0.0, weighted_count: bool = False, keep_sum: tuple[str, ...] = ()
) -> DataFrame:
    """Per point: sum of weight(distance) * value over the atoms within r, and n_atoms.

    With avg_pow the sums are divided by (n or the sum of weights) ** avg_pow; an
    undefined divisor counts as 1, and columns in keep_sum are multiplied back. Points
    without an atom have no row.
    """
    pairs = near(points, atoms, ["id", *values], r)
    w = weight(F.sqrt("d2"))
    sums = pairs.withColumn("w", w).groupBy("id").agg(
        *(F.sum(F.col("w") * F.col(f"{v}_r")).alias(v) for v in values), F.sum("w").alias("_w"), F.count("*").alias("n_atoms")
    )
    if avg_pow:
        base = F.pow(F.col("_w") if weighted_count else F.col("n_atoms").cast("double"), F.lit(avg_pow))
        base = F.when(base.isNull() | F.isnan(base) | (base == 0) | (F.abs(base) == float("inf")), 1.0).otherwise(base)
        sums = sums.withColumns({v: F.col(v) if v in keep_sum else F.col(v) / base for v in values})
    return sums.select("id", *values, "n_atoms")


def fixed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value: at or below low is 0, at or above high the last one."""
    at = F.floor((value - low) / F.lit((high - low) / bins)).cast("long")
    return F.when(value <= low, F.lit(0)).when(value >= high, F.lit(bins - 1)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("long")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(fixed_bin(F.col(value), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def smooth_bins(value: Column, low: float, high: float, bins: int) -> Column:
    """Array of (bin, share): bins stand at equal steps from low to high, both included, and a value
    counts in the two that enclose it, by distance; one at or beyond an end counts whole there."""
    if bins < 2:
        raise ValueError("a smooth histogram has two bins at least")
    step = (high - low) / (bins - 1)
    pos = F.least(F.greatest((value - low) / F.lit(step), F.lit(0.0)), F.lit(float(bins - 1)))
    b0 = F.least(F.floor(pos).cast("long"), F.lit(bins - 2))
    frac = pos - b0
    return F.array(F.struct(b0.alias("bin"), (1.0 - frac).alias("share")), F.struct((b0 + 1).alias("bin"), frac.alias("share")))


def shares(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, smooth: bool) -> DataFrame:
    """keys, bin and share of each row's value in a histogram, in up to two bins if it is smooth."""
    if smooth:
        return df.select(*keys, F.explode(smooth_bins(F.col(value), low, high, bins)).alias("_b")).select(*keys, "_b.bin", "_b.share")
    return df.select(*keys, fixed_bin(F.col(value), low, high, bins).alias("bin"), F.lit(1.0).alias("share"))


def pair_distances(points: DataFrame, by: str, low: float, high: float, bins: int, smooth: bool = False, normalised: bool = False) -> DataFrame:
    """(by, bin, n): histogram of the distances between the points of each group, every pair once and
    each point with itself; normalised: as shares of all pairs. Empty bins have no row.

    Only pairs nearer than ``high`` are made, by cubes. All others count whole in the last
    bin, and their number follows from the size of the group.
    """
    near = close_pairs(points.select("id", *XYZ, by), high, by)
    size = points.groupBy(by).agg(F.count("*").alias("_m"))
    made = near.groupBy(by).agg(F.count("*").alias("_made"))
    total = F.col("_m") * (F.col("_m") + 1) / 2
    own = size.join(made, by, "left").select(by, "_m", total.alias("_all"), (total - F.col("_m") - F.coalesce("_made", F.lit(0))).alias("_far"))
    rest = own.select(by, F.explode(F.array(F.struct(F.lit(0.0).alias("dist"), F.col("_m").cast("double").alias("w")), F.struct(F.lit(float(high)).alias("dist"), F.col("_far").alias("w")))).alias("_r"))
    at = lambda df, w: shares(df.withColumn("_w", w), [by, "_w"], "dist", low, high, bins, smooth).select(by, "bin", (F.col("share") * F.col("_w")).alias("n"))
    parts = at(near.select(by, F.sqrt("d2").alias("dist")), F.lit(1.0)).unionByName(at(rest.select(by, "_r.dist", "_r.w"), F.col("w")))
    got = parts.groupBy(by, "bin").agg(F.sum("n").alias("n")).where("n > 0")
    return got.join(own.select(by, "_all"), by).select(by, "bin", (F.col("n") / F.col("_all")).alias("n")) if normalised else got


def confusion(df: DataFrame, observed: str, score: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts tp, fp, tn, fn and absolute and squared errors in total and per observed class."""
    o, s = F.col(observed), F.col(score)
    p, err = s >= threshold, F.abs(o.cast("double") - s)
    n = lambda c: F.sum(c.cast("long"))
    part = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    return df.groupBy(*by).agg(
        n(o & p).alias("tp"), n(~o & p).alias("fp"), n(~o & ~p).alias("tn"), n(o & ~p).alias("fn"),
        F.sum(err).alias("sum_e"), part(o, err).alias("sum_e_pos"), part(~o, err).alias("sum_e_neg"),
        F.sum(err * err).alias("sum_se"), part(o, err * err).alias("sum_se_pos"), part(~o, err * err).alias("sum_se_neg"),
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the divisor is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def classifier_metrics(c: DataFrame) -> DataFrame:
    """Metrics of confusion counts. Undefined ones are null; an undefined MCC is 1.

    The errors per class are divided by the total count, as are the overall ones.
    """
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    spc, npv = ratio(tn, tn + fp), ratio(tn, tn + fn)
    fpr, fnr = ratio(fp, fp + tn), ratio(fn, tp + fn)
    f = lambda b: ratio((1 + b * b) * p * r, b * b * p + r)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den == 0, 1.0).otherwise(ratio(tp * tn - fp * fn, den))
    plr, nlr = ratio(r, fpr), ratio(fnr, spc)
    out = {
        "p": p, "r": r, "f1": f(1.0), "f2": f(2.0), "f05": f(0.5), "mcc": mcc, "npv": npv, "spc": spc, "acc": ratio(tp + tn, n), "bacc": (r + spc) / 2,
        "tpx": ratio(tp, tp + fn + fp), "fpr": fpr, "fnr": fnr, "plr": plr, "nlr": nlr, "dor": ratio(plr, nlr), "fdr": ratio(fp, fp + tp), "fom": ratio(fn, fn + tn),
        "yjs": r + spc - 1, "mrk": p + npv - 1, "me": ratio(F.col("sum_e"), n), "me_pos": ratio(F.col("sum_e_pos"), n), "me_neg": ratio(F.col("sum_e_neg"), n),
        "mse": ratio(F.col("sum_se"), n), "mse_pos": ratio(F.col("sum_se_pos"), n), "mse_neg": ratio(F.col("sum_se_neg"), n),
    }
    return c.withColumns(out)


def score_levels(df: DataFrame, observed: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, and those at or above it.

    Ranking metrics only need these: one row per distinct score, not per prediction.
    Running sums go by ranges of the scores there are, so that no task sees all levels.
    """
    levels = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(observed).cast("long")).alias("pos"), F.sum((~F.col(observed)).cast("long")).alias("neg"))
    return prefix_sums(levels, [F.desc("s")], {"pos": "tp", "neg": "fp"})


def auc(df: DataFrame, observed: str, score: str) -> DataFrame:
    """One row: auc (ties count half), auprc (step-wise average precision), n_pos, n_neg."""
    v = score_levels(df, observed, score)
    area = F.sum(F.col("pos") * ((F.col("fp") - F.col("neg")) + F.col("neg") / 2.0))
    precision = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    total = v.agg(area.alias("below"), precision.alias("ap"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    lost = ratio(F.col("below"), F.col("n_pos") * F.col("n_neg"))
    return total.select((1.0 - lost).alias("auc"), ratio(F.col("ap"), F.col("n_pos")).alias("auprc"), "n_pos", "n_neg")


def moments(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sample variance, and skewness and excess kurtosis with bias correction."""
    v = F.col(value)
    g = df.groupBy(*by).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"))
    n = F.col("n")
    skew = F.when(n >= 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return g.select(*by, F.col("n").cast("long").alias("n"), "mean", "variance", skew.alias("skewness"), kurt.alias("kurtosis"))


def log_loss(observed: Column, score: Column, floor: float = 0.01) -> Column:
    """Mean negative log likelihood; the probability of what was observed is floored from below only."""
    p = F.when(observed, score).otherwise(1.0 - score)
    return F.avg(-F.log(F.greatest(p, F.lit(floor))))


def sample_stats(value: Column) -> list[Column]:
    """sum, mean, var (n - 1), sd, relative sd in per cent, min and max of a sample."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    return [F.sum(value).alias("sum"), mean.alias("mean"), F.var_samp(value).alias("var"), sd.alias("sd"), (100.0 * F.try_divide(sd, mean)).alias("rel_sd"), F.min(value).alias("min"), F.max(value).alias("max")]


def merged(parts: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Partial counts and sums of the same things added up."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))


def mean_scores(df: DataFrame, observed: str, score: str) -> DataFrame:
    """One row: the mean score, and that of the positives."""
    return df.agg(F.avg(score).alias("mean_score"), F.avg(F.when(F.col(observed), F.col(score))).alias("mean_pos"))


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: all rows, positives, negatives and those without a label."""
    c = F.col(label)
    return df.agg(F.count("*").alias("total"), F.count_if(c).alias("pos"), F.count_if(~c).alias("neg"), F.count_if(c.isNull()).alias("unlabelled"))


def transformed_score(score: Column, power: float, least: float = 0.0) -> Column:
    """What a score exceeds ``least`` by, to a power; lower ones count 0."""
    return F.pow(F.greatest(score - F.lit(float(least)) if least else score, F.lit(0.0)), F.lit(float(power)))


def normalised_score(a: Column, b: Column) -> Column:
    """The share a / (a + b); null for an empty whole, and 0 for a negative share."""
    share = F.try_divide(a, a + b)
    return F.when(share.isNotNull(), F.greatest(share, F.lit(0.0)))


def pocket_scores(points: DataFrame, by: list[str], score: str = "score", tie: str = "id", power: float = 2.0, limit: int = 0) -> DataFrame:
    """Per pocket: score, the sum of its points' transformed scores (of the ``limit`` best, if
    that is set), mean_score and n, over all its points."""
    x = points.withColumn("_t", transformed_score(F.col(score), power))
    if limit:
        best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
        x = x.withColumn("_t", F.when(best <= limit, F.col("_t")).otherwise(0.0))
    return x.groupBy(*by).agg(F.sum("_t").alias("pocket_score"), F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def standardised(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """Each value less the mean, over the deviation of all; null without spread."""
    m = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    # one row of two numbers
    return df.crossJoin(F.broadcast(m)).withColumn(name, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def over_runs(stats: DataFrame, name: str, run: str, value: str, runs: list) -> DataFrame:
    """Per number: mean, sample deviation (sd), the deviation in per cent of the mean, and the value in each run."""
    v, sd = F.avg(value), F.stddev_samp(value)
    return stats.groupBy(name).agg(v.alias("mean"), sd.alias("sd"), F.try_divide(100 * sd, v).alias("rel_sd"), *(F.max(F.when(F.col(run) == r, F.col(value))).alias(f"run_{r}") for r in runs))


def parameter_table(results: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """The mean of a result for each pair of parameter values, a column for each value of the second."""
    return results.groupBy(row).pivot(column, values).agg(F.avg(value))


def distinct_average(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """The mean over the distinct keys of each group; a key has one value."""
    return df.dropDuplicates([*by, key]).groupBy(*by).agg(F.avg(value).alias("mean"))
