"""Keyed state over event streams: sessions with timers, and pairs of events of two streams.

State lives in the state store and is bounded by the watermark: rows later than that are dropped, sessions
are handed on and forgotten when it passes their end, and a join keeps a row only while a partner may come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that typed state and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Let the session's queries keep their state where ``sessions_with_state`` needs it. Queries that
    have a checkpoint of another store don't start after that."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def merged(sessions: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Sessions (begin, end, n, total) in order, those that overlap or touch in time made one, as session
    windows are."""
    out: list[tuple[int, int, int, float]] = []
    for b, e, n, t in sorted(sessions):
        if out and b <= out[-1][1]:
            c = out.pop()
            b, e, n, t = c[0], max(c[1], e), c[2] + n, c[3] + t
        out.append((b, e, n, t))
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a key. Events may come in any order before the watermark; a timer for each end
    hands a session on when no event can lengthen it any more."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin long, end long, n long, total double")

    def _kept(self) -> list[tuple[int, int, int, float]]:
        return [(int(r[0]), int(r[1]), int(r[2]), float(r[3])) for r in self.open.get()] if self.open.exists() else []

    def _keep(self, sessions: list[tuple[int, int, int, float]]) -> None:
        self.open.put(sessions) if sessions else self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = []
        for pdf in rows:
            new += [(int(us), int(us) + self.gap, 1, float(v)) for us, v in zip(pdf["us"], pdf["value"], strict=True)]
        now = merged(self._kept() + new)
        self._keep(now)
        timers = set(self.handle.listTimers()) if hasattr(self.handle, "listTimers") else set()
        for _, end, _, _ in now:
            at = -(-end // 1000)
            if at not in timers:
                self.handle.registerTimer(at)
        yield pd.DataFrame({"key": [], "begin": [], "end": [], "n": [], "total": []}).astype({"key": "str", "begin": "int64", "end": "int64", "n": "int64", "total": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        done = [s for s in self._kept() if s[1] <= upto]
        self._keep([s for s in self._kept() if s[1] > upto])
        yield pd.DataFrame([(str(key[0]), *s) for s in done], columns=["key", "begin", "end", "n", "total"])

    def close(self) -> None:
        pass


def sessions_with_state(events: DataFrame, gap_ms: int = 1_800_000, late: str = "10 minutes", user: str = "user_id") -> DataFrame:
    """A stream's sessions (key, begin, end in microseconds, n, total), each once when the watermark has passed it.

    The same as ``folder.sessions``, but kept by code of one's own, which can hold other state as well.
    Events later than the watermark are dropped. See ``use_state_store``.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col(user).cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("value").cast("double").alias("value"))
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Sessions(gap_ms), "key string, begin long, end long, n long, total double", outputMode="append", timeMode="eventTime")


def followed(first: DataFrame, second: DataFrame, user: str = "user_id", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user, first_id, second_id, first_ts, second_ts): events of a stream with those of another that follow them within a time.

    Both have event_id and ts. The bound on the time between them lets either side forget rows that the
    watermarks have left behind.
    """
    side = lambda df, n: df.select(F.col(user).alias(f"{n}_user"), F.col("event_id").alias(f"{n}_id"), F.col("ts").cast("timestamp").alias(f"{n}_ts")).withWatermark(f"{n}_ts", late)
    a, b = side(first, "first"), side(second, "second")
    near = F.expr(f"first_user = second_user AND second_ts >= first_ts AND second_ts <= first_ts + INTERVAL {within}")
    return a.join(b, near).select(F.col("first_user").alias(user), "first_id", "second_id", "first_ts", "second_ts")
