"""Streams with late rows, keyed state with timers, and a join of two streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orrery.streaming import folder, state

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string, value double"
NOON = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of files, one in each trigger, in the order given."""

    def write(batches, name="in"):
        import time

        for n, rows in enumerate(batches):
            path = tmp_path / name / f"{n}"
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path))
            time.sleep(0.05)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")

    return write


def drained(stream, tmp_path, name="out"):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return stream.sparkSession.read.parquet(str(tmp_path / name)).collect()


def test_rates_drop_rows_behind_the_watermark(arriving, tmp_path):
    batches = [
        [(1, 1, at(0), "view", 1.0), (1, 2, at(5), "view", 3.0)],
        [(1, 3, at(50), "view", 8.0), (2, 4, at(52), "click", 5.0)],
        # in time, as the watermark stands at 42
        [(1, 5, at(43), "view", 100.0), (2, 6, at(180), "view", 1.0)],
        [(2, 10, at(181), "view", 1.0)],
        # late: the watermark stands at 170
        [(1, 7, at(10), "view", 1000.0), (1, 8, at(400), "view", 1.0)],
        [(9, 9, at(900), "view", 1.0)],
    ]
    got = {(r.window.start, r.event_type): (r.n, r.mean) for r in drained(folder.event_rates(arriving(batches)), tmp_path)}
    assert got[at(0), "view"] == (4, 28.0) and got[at(0), "click"] == (1, 5.0) and got[at(180), "view"] == (2, 1.0)


def test_sessions_by_state_and_by_window(spark, arriving, tmp_path, monkeypatch):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_state_store(spark)
    try:
        r = random.Random(6)
        rows = [(r.randrange(4), n, at(r.uniform(0, 600)), "view", float(n)) for n in range(60)]
        rows += [(7, 100, at(0), "view", 1.0), (7, 101, at(30), "view", 2.0), (7, 102, at(60.5), "view", 4.0)]  # exactly the gap, and more
        rows.sort(key=lambda x: x[2])
        # batches in order, each a little out of order within
        batches = [rows[k : k + 16] for k in range(0, len(rows), 16)]
        late = [(7, 900, at(1), "view", 1e6), (0, 901, at(2), "view", 1e6)]
        end = [(99, 999, at(5000), "view", 0.0)]
        got = drained(state.sessions_with_state(arriving([*batches, end, [(99, 997, at(5001), "view", 0.0)], late, [(99, 998, at(9000), "view", 0.0)]])), tmp_path)
        found = {(x.key, x.begin, x.end, x.n, round(x.total, 6)) for x in got if x.key != "99"}
        whole = folder.sessions(spark.createDataFrame(rows, SCHEMA)).select(F.col("user_id").cast("string"), F.unix_micros("begin"), F.unix_micros("end"), "n", F.round("total", 6))
        assert found == {tuple(x) for x in whole.collect()} and len(got) == len(set(got))
        assert {(x[3], x[4]) for x in found if x[0] == "7"} == {(2, 3.0), (1, 4.0)}
    finally:
        spark.conf.set(key, before)


def test_sessions_merge():
    assert state.merged([(51, 80, 1, 2.0), (0, 30, 1, 1.0), (20, 50, 2, 4.0), (80, 90, 1, 1.0)]) == [(0, 50, 3, 5.0), (51, 90, 2, 3.0)]
    assert state.merged([]) == []


def test_streams_are_joined_within_a_time(arriving, tmp_path):
    views = arriving([[(1, 1, at(0), "view", 0.0), (2, 2, at(10), "view", 0.0)], [(1, 3, at(100), "view", 0.0)], [(1, 4, at(2000), "view", 0.0)], [(1, 6, at(2001), "view", 0.0)], [(1, 5, at(50), "view", 0.0)]], "views")
    buys = arriving([[(1, 11, at(60), "buy", 0.0), (1, 12, at(61), "buy", 0.0), (2, 13, at(5), "buy", 0.0)], [(1, 14, at(130), "buy", 0.0)], [(3, 15, at(2000), "buy", 0.0)], [(3, 17, at(2001), "buy", 0.0)], [(1, 16, at(70), "buy", 0.0)]], "buys")
    got = {(r.user_id, r.first_id, r.second_id) for r in drained(state.followed(views, buys), tmp_path)}
    # 60 minutes after the first view and 30 after the third; the last pair came when both were forgotten
    assert got == {(1, 1, 11), (1, 3, 14)}
