"""Running sums and digests along an order, for keys that may hold any share of the rows.

Rows are sorted by key and order over all partitions, so a long key has several of them. A
partition sums its own part; the driver carries one row per partition from each to the
next. Groups are streamed and never gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T


def _local(keep: list[str]):
    """Sums of ``_v`` along the sorted rows of a partition, anew for each ``_k``."""

    @T.lean
    def run(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            k, v = batch.column("_k").to_numpy(), batch.column("_v").to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.flatnonzero(new)
            upto = np.cumsum(v)
            before = (upto - v)[start]
            before[0] -= total if k[0] == last else 0
            sums = upto - before[np.cumsum(new) - 1]
            last, total = k[-1], int(sums[-1])
            cols = [batch.column(c) for c in ("_k", *keep)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sums), pa.array(np.full(len(k), part, np.int32))], ["_k", *keep, "_sum", "_part"])

    return run


def running(df: DataFrame, key: str, order: list[Column], value: Column, name: str, keep: list[str]) -> DataFrame:
    """``key`` (long, not null), the columns ``keep``, and as ``name`` the sum of ``value`` over the
    rows of the key up to each row in ``order``. Values are whole and not negative; rows that tie
    in ``order`` are summed one after the other."""
    spark = df.sparkSession
    by = [f"_o{n}" for n in range(len(order))]
    rows = df.select(F.col(key).cast("long").alias("_k"), value.cast("long").alias("_v"), *keep, *(c.alias(n) for c, n in zip(order, by, strict=True)))
    ranges = rows.repartitionByRange(T.tasks(spark), "_k", *by).sortWithinPartitions("_k", *by)
    schema = "_k long, " + "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep) + "_sum long, _part int"
    placed = T.stored(ranges.select("_k", "_v", *keep).mapInArrow(_local(keep), schema))
    # a row for each partition: its least and last key and how far the last one's sum has come
    ends = placed.groupBy("_part").agg(F.min("_k").alias("low"), F.max(F.struct("_k", "_sum")).alias("high")).orderBy("_part").collect()
    carried, bases = 0, []
    for n, e in enumerate(ends):
        carried = carried if n and ends[n - 1].high._k == e.low else 0
        bases.append((e._part, e.low, carried))
        carried = e.high._sum + (carried if e.low == e.high._k else 0)
    base = F.broadcast(spark.createDataFrame(bases, "_part int, _k long, _base long"))
    return placed.join(base, ["_part", "_k"], "left").select(F.col("_k").alias(key), *keep, (F.col("_sum") + F.coalesce("_base", F.lit(0))).alias(name))


def _joined(size: int):
    """The values of each group as comma-joined strings of about ``size`` numbers, with the least of each."""

    @T.lean
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cuts = np.append(T.boundaries(batch, ["a", "b"]), batch.num_rows)
            a, b, v = (batch.column(c).to_numpy() for c in ("a", "b", "v"))
            at = [x for s, e in zip(cuts[:-1], cuts[1:], strict=True) for x in range(s, e, size)]
            text = [",".join(map(str, v[s:e].tolist())) for s, e in zip(at, [*at[1:], batch.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(v[at]), pa.array(text, pa.string())], ["a", "b", "v", "text"])

    return run


@T.lean
def _hashed(batches):
    """SHA-256 of each group's strings in their order, a comma between them."""
    now, state = None, None
    for batch in batches:
        out = []
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (a, b) == now:
                state.update(b"," + text.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (a, b), hashlib.sha256(text.encode())
        yield _digests(out)
    if now is not None:
        yield _digests([(*now, state.hexdigest())])


def _digests(rows) -> pa.RecordBatch:
    a, b, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], ["a", "b", "sha"])


def joined_sha256(df: DataFrame, keys: tuple[str, str], value: str, name: str) -> DataFrame:
    """The two long ``keys`` and as ``name`` the lowercase SHA-256 of the group's decimal values,
    ascending and comma-joined.

    A digest of one string is made byte after byte, so the strings of a group end in one
    task; it reads them as they come, some thousand numbers to a row, and holds none of them.
    """
    n = T.tasks(df.sparkSession)
    rows = df.select(*(F.col(k).cast("long").alias(x) for k, x in zip(keys, "ab", strict=True)), F.col(value).cast("long").alias("v"))
    ranges = rows.repartitionByRange(n, "a", "b", "v").sortWithinPartitions("a", "b", "v")
    parts = ranges.mapInArrow(_joined(8192), "a long, b long, v long, text string")
    done = parts.repartition(n, "a", "b").sortWithinPartitions("a", "b", "v").mapInArrow(_hashed, "a long, b long, sha string")
    return done.select(F.col("a").alias(keys[0]), F.col("b").alias(keys[1]), F.col("sha").alias(name))
