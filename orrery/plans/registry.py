"""Registration of queries with their SQL twins, and the derived views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views over the driver tables, the same as in ``view``.
VIEWS = {
    "pts": """pts AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, CAST(embedding[1] AS DOUBLE) * 50 AS x, CAST(embedding[2] AS DOUBLE) * 50 AS y,
  CAST(embedding[3] AS DOUBLE) * 50 AS z, CAST(vec_id * 37 % 101 AS DOUBLE) / 100 AS score, vec_id % 10 = 0 AS lig FROM embeddings)""",
    "pred": "pred AS (SELECT l_returnflag = 'R' AS obs, round(l_discount * 10, 2) AS s FROM lineitem)",
    "chain": "chain AS (SELECT user_id, ts, event_id, event_type AS t, substr(event_type, 1, 1) AS letter, value FROM events)",
}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir); ``sql`` follows the WITH clause of ``views``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            head = ", ".join(VIEWS[v] for v in views)
            body = sql.strip()
            if head:
                body = f"WITH RECURSIVE {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
            ORACLE[name] = body
        return fn

    return add


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled, scored points; each tenth is a ligand atom."""
    e = table(spark, sf_dir, "embeddings")
    at = {c: F.col("embedding")[i].cast("double") * 50 for i, c in enumerate("xyz")}
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), *(v.alias(c) for c, v in at.items()),
        ((F.col("vec_id") * 37 % 101).cast("double") / 100).alias("score"), (F.col("vec_id") % 10 == 0).alias("lig"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as binary predictions with heavily tied scores."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("obs"), F.round(F.col("l_discount") * 10, 2).alias("s"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as residues of chains: by user, in order of time."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("t"), F.substring("event_type", 1, 1).alias("letter"), "value")


CHAIN_ORDER = ["ts", "event_id"]


def r6(c, digits: int = 6):
    return F.round(c, digits)
