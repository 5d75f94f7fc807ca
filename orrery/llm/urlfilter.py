"""URL filter: host and path rules first, then the ratio of two character language models.

Rules label part of the URLs. Two variable-order Markov models, one of accepted and one
of rejected URLs, are estimated from the labelled ones: P_m(c | h) interpolates the
counts after the last m - 1 characters with the next shorter context by Witten-Bell
weights, down to a uniform distribution. A URL's score is the mean over its characters
of ln P(accepted model) - ln P(rejected model); the threshold is calibrated on labelled
URLs that were kept from the counts.

Everything is built-in expressions. URLs are first reduced to distinct shapes (case,
digits and the query removed), and shapes to distinct windows of ``order`` characters,
so counts and joins work on pre-aggregated rows, however often a host or URL repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.textops import column, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilter:
    """rules: (verdict, host, path prefix). order: longest window, context and character.

    alphabet: size of the uniform base distribution. One shape in ``folds``, by the
    first byte of its md5, is kept from the counts for calibration.
    """

    rules: tuple[tuple[str, str, str], ...]
    order: int = 5
    alphabet: int = 64
    folds: int = 5
    bins_per_nat: int = 100


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(h + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _fold(folds: int) -> Column:
    return F.conv(F.substring(F.md5(F.col("shape").cast("binary")), 1, 2), 16, 10).cast("int") % folds


def _windows(shapes: DataFrame, order: int) -> DataFrame:
    """Each shape's windows: every character, and the end, with the order - 1 before it."""
    padded = F.concat(F.lit("^" * (order - 1)), F.col("shape"), F.lit("$"))
    return shapes.withColumn("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("shape") + 1), lambda i: F.substring(padded, i, F.lit(order)))))


def _ratios(counts: DataFrame, p: UrlFilter) -> DataFrame:
    """(w, ratio): the difference of log probabilities of each window's last character."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(p.order)), lambda m: F.substring(F.col("w"), F.lit(p.order + 1) - m, m))
    grams = counts.withColumn("g", F.explode(suffixes))
    table = grams.groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("h", F.expr("left(g, length(g) - 1)"))
    table = saved(table)
    context = table.groupBy("h").agg(
        F.sum("a").alias("ha"), F.sum("r").alias("hr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr")
    )
    facts = table.join(context, "h").select("g", "a", "r", "ha", "hr", "ta", "tr")
    each = grams.select("w", "g").join(facts, "g").groupBy("w").agg(F.array_sort(F.collect_list(F.struct(F.length("g").alias("m"), "a", "ha", "ta", "r", "hr", "tr"))).alias("x"))

    def log_p(n: str, h: str, t: str) -> Column:
        step = lambda q, x: F.when(x[h] + x[t] > 0, (x[n] + x[t] * q) / (x[h] + x[t])).otherwise(q)
        return F.log(F.aggregate("x", F.lit(1.0 / p.alphabet), step))

    return each.select("w", (log_p("a", "ha", "ta") - log_p("r", "hr", "tr")).alias("ratio"))


def _threshold(scored: DataFrame, p: UrlFilter) -> DataFrame:
    """One row: the cut with the best balanced accuracy on the shapes kept for calibration; 0 without both classes."""
    held = scored.where(_fold(p.folds) == 0)
    b = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * p.bins_per_nat).cast("long")
    bins = held.groupBy(b.alias("b")).agg(F.sum("acc").cast("double").alias("a"), F.sum("rej").cast("double").alias("r"))
    # at most 40 * bins_per_nat + 1 rows from here on
    all_bins = bins.groupBy().agg(F.array_sort(F.collect_list(F.struct("b", "a", "r"))).alias("x"), F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    below = lambda k, f: F.aggregate(F.filter("x", lambda y: y["b"] < k), F.lit(0.0), lambda s, y: s + y[f])
    cuts = F.transform("x", lambda y: F.struct(((F.col("ta") - below(y["b"], "a")) / F.col("ta") + below(y["b"], "r") / F.col("tr")).alias("gain"), (-F.abs(y["b"])).alias("near"), y["b"].alias("b")))
    best = F.when((F.col("ta") > 0) & (F.col("tr") > 0), F.array_max(cuts)["b"] / F.lit(float(p.bins_per_nat)))
    return all_bins.select(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, p: UrlFilter, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score, threshold.

    rule is null where none fits; then the verdict is allow if score >= threshold, else
    block. A URL that is null or has no `://` has no characters and score 0. Without
    labelled URLs of both kinds the threshold is 0. Repeated rows each get a row; null
    ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    url = column(pages, url_col, "string")
    rows = pages.select(column(pages, id_col, "long").alias("page_id"), *(c.alias(n) for c, n in zip(parts(url), ("host", "path"), strict=True)))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), p.rules))
    shape = F.translate(F.concat("host", F.translate("path", UPPER, LOWER)), "123456789", "000000000")
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("given"), shape.alias("shape"))
    shapes = saved(rows.groupBy("shape").agg(F.count_if(F.col("given") == "allow").alias("acc"), F.count_if(F.col("given") == "block").alias("rej")))
    learn = F.when(_fold(p.folds) != 0, 1).otherwise(0)
    windows = _windows(shapes, p.order)
    counts = saved(windows.groupBy("w").agg(F.sum(F.col("acc") * learn).alias("a"), F.sum(F.col("rej") * learn).alias("r")))
    scored = saved(windows.join(_ratios(counts, p), "w").groupBy("shape").agg(F.avg("ratio").alias("score"), F.first("acc").alias("acc"), F.first("rej").alias("rej")))
    scored = scored.withColumn("score", F.when(F.length("shape") > 0, F.col("score")).otherwise(0.0))
    # one row of two numbers
    cut = F.broadcast(_threshold(scored, p))
    out = rows.join(scored.select("shape", "score"), "shape", "left").crossJoin(cut)
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.col("threshold"), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", by_model).alias("verdict"), "score", "threshold")
