"""Interaction audit of document filters by inclusion and exclusion.

Each document's failures are 0/1 flags. One aggregation per part sums the product of the
flags of each of the 2**k intersections: how many documents fail all of its filters. That
is all that is counted. Möbius inversion turns these sums into

* the documents that survive a set P of filters: the sum over T within P of (-1)**|T| n(T);
* those that fail a filter and no other, by the same sum over the sets that hold it;
* what a filter removes behind others, the difference of two survivors, and how much of
  what fails it was gone before;
* the game v(P) = documents removed by P, whose Harsanyi dividends are (-1)**(|T|+1) n(T),
  so that a filter's Shapley value is the sum of dividend / |T| over the sets that hold it.

The same sums weighted by labels tell what of them is lost. Nothing is run per order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T

#: What separates words; between ends of the text it leaves empty strings.
_BLANKS = "[\\x20\\x09-\\x0D]+"


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and five failures, 1 or 0, of each whole text: A under 100 words; B under
    80 distinct words in 100; C more than one code point in ten is an ASCII capital; D holds one of
    ``#$%&*|``; E is identical to the text of a smaller doc_id anywhere in the table.

    A null text is empty, a null part the empty string. A text without words fails A but not B. A
    null doc_id never fails E and makes no other row fail; rows that repeat a doc_id don't make each
    other fail. Other columns are ignored; an empty table gives an empty result. Texts are
    compared by their SHA-256; only digests and flags are shuffled.
    """
    text = F.coalesce(T.column(docs, text_col, "string"), F.lit(""))
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), F.coalesce(T.column(docs, part_col, "string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", _BLANKS), "")
    measured = src.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"), "text")
    own = {
        "A": F.size("words") < 100,
        "B": F.size(F.array_distinct("words")) * 100 < F.size("words") * 80,
        "C": F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.length("text") * 10,
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    flags = T.stored(measured.select("doc_id", "part", "digest", *(c.cast("int").alias(k) for k, c in own.items())))
    # written first: a join of two plain shuffles can have the partition of a text with many copies split
    first = T.stored(flags.groupBy("digest").agg(F.min("doc_id").alias("first")))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return flags.join(first, "digest").select("doc_id", "part", *own, later.alias("E"))


def with_labels(flags: DataFrame, labels: DataFrame, weights: Mapping[str, str], id_col: str = "doc_id") -> DataFrame:
    """The flags with a column, 1 or 0, for each weight: whether a row of ``labels`` with the
    document's id meets its condition in SQL. A document without a label, or without an id, has 0."""
    one = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(k) for k, c in weights.items()]
    found = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(T.column(labels, id_col, "long").alias("doc_id")).agg(*one)
    return flags.join(found, "doc_id", "left").fillna(0, list(weights))


def joint_failures(flags: DataFrame, filters: Sequence[str], part: str = "part", weights: Sequence[str] = ()) -> DataFrame:
    """One row per part: ``n_<set>`` of each set of filters, the documents that fail all of them
    (``n_`` of none: all documents), and ``<weight>_<set>``, the same sums weighted."""
    names = sets_of(filters)
    product = {s: reduce(mul, [F.col(f) for f in s], F.lit(1)) for s in names}
    sums = [F.sum(product[s] * w).alias(f"{k}_{''.join(s)}") for k, w in [("n", F.lit(1)), *((x, F.col(x)) for x in weights)] for s in names]
    return flags.groupBy(part).agg(*sums)


def sets_of(filters: Sequence[str]) -> list[tuple[str, ...]]:
    """All sets of filters, the set of bits b at place b."""
    return [tuple(f for n, f in enumerate(filters) if b >> n & 1) for b in range(1 << len(filters))]


def _survivors(of: str, sets: list[tuple[str, ...]]) -> Column:
    """For each set of filters the documents that fail none of them."""
    signed = lambda s: F.col(f"{of}_{''.join(s)}") * (-1) ** len(s)
    return F.array(*(reduce(add, [signed(s) for b, s in enumerate(sets) if b & ~within == 0]) for within in range(len(sets))))


def _per_filter(filters: Sequence[str], sets: list[tuple[str, ...]], value) -> Column:
    """For each filter the sum of ``value`` times the joint failures of the sets that hold it."""
    return F.array(*(reduce(add, [F.col(f"n_{''.join(s)}") * value(len(s)) for s in sets if f in s]) for f in filters))


def audit(joint: DataFrame, filters: Sequence[str], part: str = "part", weights: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of all filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, shapley, and ``lost_<weight>``.

    shapley is the Shapley value of the step's filter times the number of orders, a whole number.
    ``filters`` are up to six single letters, as rows grow with their factorial.
    """
    if not 1 <= len(filters) <= 6 or any(len(f) != 1 for f in filters):
        raise ValueError("one to six filters named by single letters")
    sets, k = sets_of(filters), len(filters)
    whole = joint.select(
        part,
        *(_survivors(w, sets).alias(f"_{w}") for w in ("n", *weights)),
        F.array(*(F.col(f"n_{f}") for f in filters)).alias("_fails"),
        # exactly this filter: its sets counted with alternating signs
        _per_filter(filters, sets, lambda size: (-1) ** (size - 1)).alias("_unique"),
        # dividends shared evenly; every share of k! orders is whole
        _per_filter(filters, sets, lambda size: (-1) ** (size + 1) * math.factorial(k) // size).alias("_shapley"),
    )
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    rows = whole.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    upto = lambda steps: reduce(add, [F.when(F.substring("filter_order", F.lit(1), steps).contains(f), 1 << n).otherwise(0) for n, f in enumerate(filters)])
    rows = rows.withColumn("_before", upto(F.col("step") - 1)).withColumn("_after", upto(F.col("step")))
    rows = rows.withColumn("_f", F.instr(F.lit("".join(filters)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    lost = lambda w: F.get(f"_{w}", F.col("_before")) - F.get(f"_{w}", F.col("_after"))
    return rows.select(
        part,
        "filter_order",
        "step",
        F.get("_n", F.col("_after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("_fails", F.col("_f")) - lost("n")).alias("redundant"),
        F.get("_unique", F.col("_f")).alias("unique_fails"),
        *(lost(w).alias(f"lost_{w}") for w in weights),
        F.get("_shapley", F.col("_f")).alias("shapley"),
    )
