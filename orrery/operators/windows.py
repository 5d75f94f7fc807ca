"""Ranking, neighbour and run operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.session import cut


def ranked(df: DataFrame, by: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank 1..n by descending score; ties go to the smaller ``tie``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def inverse_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Score n, n - 1, .. 1 along the given order."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("score", n - F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + 1)


def head_reordered(df: DataFrame, by: list[str], order: list, score: str, n: int) -> DataFrame:
    """Rank in which only the first n rows are put in order of score; the others keep their place."""
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    key = F.when(F.col("_place") <= n, -F.col(score))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(key), "_place")
    return df.withColumn("rank", F.row_number().over(w)).drop("_place")


def neighbours(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """prev and next value in order; null at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("prev", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def islands(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Maximal runs of equal values: section number from 1, position in it from 1, its length, and relative position."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("_turn", turn).withColumn("section", F.sum("_turn").over(w)).drop("_turn")
    s = Window.partitionBy(*by, "section")
    df = df.withColumn("pos", F.row_number().over(s.orderBy(*order)).cast("long")).withColumn("length", F.count("*").over(s))
    return df.withColumn("rel_pos", F.col("pos") / F.col("length"))


def sections(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per section of ``islands`` with the values of the sections before and after it."""
    one = df.groupBy(*by, "section").agg(F.first(value).alias(value), F.max("length").alias("length"))
    w = Window.partitionBy(*by).orderBy("section")
    return one.withColumn("prev_type", F.lag(value).over(w)).withColumn("next_type", F.lead(value).over(w))


def duplets(df: DataFrame, by: list[str], order: list, letter: str) -> DataFrame:
    """Both ordered pairs of each row, with the one before it and the one after it; `_` stands beyond the ends."""
    x = neighbours(df, by, order, letter)
    pair = lambda a, b: F.when(a <= b, F.concat(a, b)).otherwise(F.concat(b, a))
    me, prev, nxt = F.coalesce(F.col(letter), F.lit("?")), F.coalesce("prev", F.lit("_")), F.coalesce("next", F.lit("_"))
    return x.withColumn("duplet", F.explode(F.array(pair(me, prev), pair(me, nxt)))).drop("prev", "next")


def triplets(df: DataFrame, by: list[str], order: list, letter: str) -> DataFrame:
    """(before, this, after), turned round if the first is greater than the last."""
    x = neighbours(df, by, order, letter)
    me, prev, nxt = F.coalesce(F.col(letter), F.lit("?")), F.coalesce("prev", F.lit("_")), F.coalesce("next", F.lit("_"))
    return x.withColumn("triplet", F.when(prev <= nxt, F.concat(prev, me, nxt)).otherwise(F.concat(nxt, me, prev))).drop("prev", "next")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """For each name the running sum of a column over the whole table in an order that tells rows apart.

    Rows are dealt to ranges of the order, sampled from the data, and summed within each; what comes
    before a range is the sum of the ranges ahead of it, of which there is one row each. Whatever
    the values are, no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down, so that a row's range stays what it is
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_t{n}") for n, c in enumerate(sums)))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_t{n}").over(upto), F.lit(0)).alias(f"_b{n}") for n in range(len(sums))))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_part")
    return out.select(*df.columns, *((F.col(f"_b{n}") + F.sum(c).over(within)).alias(name) for n, (c, name) in enumerate(sums.items())))


def running_max(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    return df.withColumn("best", F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_sum(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    return df.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_or_last(df: DataFrame, by: list[str], order: list, n: int, last: bool = False) -> DataFrame:
    """The first n rows of each group, or the last n in reversed order, with their place."""
    rev = Window.partitionBy(*by).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(rev)
    df = df.withColumn("place", (total - place + 1 if last else place).cast("long"))
    return df.where(F.col("place") <= n)


def propensities(df: DataFrame, key: str, positive: Column) -> DataFrame:
    """Per key: positives, negatives, count and share of positives; rows without a label don't count."""
    df = df.withColumn("_p", positive).where(F.col("_p").isNotNull())
    return df.groupBy(key).agg(F.sum(F.col("_p").cast("long")).alias("pos"), F.sum((~F.col("_p")).cast("long")).alias("neg"), F.count("*").alias("count"), F.avg(F.col("_p").cast("double")).alias("ratio"))


def ordered(df: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    """The place of each row in its group; the order must tell all rows of a group apart."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
