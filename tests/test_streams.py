import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog
from tessera.session import new_folder
from tessera.streaming import reading, replay, usage

SCHEMA = "user_id long, ts timestamp, id long, line string, amount long"
NOON = datetime.datetime(2024, 3, 1, 23, 59, 0)


def at(s):
    return NOON + datetime.timedelta(seconds=s)


def test_added_by_hand():
    us = lambda s: int((at(s) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    seen = {}
    days = reading.added(None, seen, [(us(0), 1, "a", 5), (us(30), 2, "a", 7), (us(90), 3, "b", 2), (us(1000), 4, "b", 2)])
    d = us(0) // reading.DAY_US
    assert days == {d: [60_000_000, 1, 5, 1], d + 1: [150_000_000, 1, 2, 1]}
    assert seen == {"a": d, "b": d + 1}
    assert reading.added((us(1000), "b"), seen, [(us(1000), 5, "b", 9)]) == {}


def played(spark, rows, forget=400, n=6):
    """Rows (slice, user, second, id, line, amount) as a stream, with an end that lets the watermark pass all."""
    df = spark.createDataFrame([(u, at(s), i, x, a, float(k) / n) for k, u, s, i, x, a in rows], SCHEMA + ", k double")
    folder = replay.slices(df, F.col("k"), n, {"user_id": F.lit(-1), "ts": F.lit(at(10**8))})
    out = new_folder(spark, "t")
    with reading.state_store(spark):
        replay.play(folder, df.schema, lambda x: reading.log(x.drop("k"), "3 days", forget), usage.additive_sink(out))
    got = reading.totals(spark.read.schema(reading.LOG.replace("day int", "day date")).parquet(out)).collect()
    return {(r.user_id, str(r.day)): (r.us, r.lines, r.amount, r.pages) for r in got}


def test_disordered_events_are_taken_in_order(spark):
    rows = [(1, 7, 90, 3, "b", 2), (0, 7, 30, 2, "a", 7), (2, 7, 0, 1, "a", 5), (3, 7, 1000, 4, None, 2), (0, 8, 10, 5, "x", 1)]
    got = played(spark, rows)
    assert got == {(7, "2024-03-01"): (60_000_000, 1, 5, 1), (7, "2024-03-02"): (150_000_000, 2, 4, 2), (8, "2024-03-01"): (0, 1, 1, 1)}


def test_late_events_drop_and_readers_are_forgotten(spark):
    week = 7 * 86_400
    rows = [(0, 7, 0, 1, "a", 1), (1, 9, 4 * week, 2, "x", 1), (2, 9, 4 * week + 1, 3, "x", 1), (3, 7, 1, 4, "late", 100), (4, 7, 5 * week, 5, "a", 1), (5, 7, 5 * week + 60, 6, "b", 1)]
    kept = played(spark, rows)
    assert (7, "2024-03-01") in kept and kept[7, "2024-03-01"][2] == 1  # the late one, a month behind, is not there
    assert kept[7, "2024-03-01"][0] + kept[7, "2024-03-02"][0] == 120_000_000
    short = played(spark, rows, forget=14)
    assert sum(v[0] for (u, _), v in short.items() if u == 7) == 60_000_000  # the gap before the return is not counted
    assert sum(v[1] for (u, _), v in short.items() if u == 7) == 3  # the line is new again


@pytest.mark.parametrize("name", ["reading_log_stream"])
def test_time_is_that_of_the_batch_query(spark, small, name):
    got = {(r.user_id, r.day): r.us for r in catalog.QUERIES[name](spark, small).collect() if r.us}
    assert got == {(r.user_id, r.day): r.us for r in catalog.QUERIES["reading_time"](spark, small).collect()}


def test_many_readers_at_once_are_as_each_alone():
    r, forget = random.Random(5), 3 * reading.DAY_US
    last, seen, alone = reading.LAST.empty_table().to_pandas(), reading.SEEN.empty_table().to_pandas(), {}
    for start in range(0, 40, 4):
        events = [(r.randrange(9), (start * reading.DAY_US + r.randrange(4 * 1440) * 60_000_000 + r.randrange(2)), k, r.choice("ab"), r.randrange(9)) for k in range(r.choice([0, 3, 40]))]
        out, last, seen = reading.taken(pd.DataFrame(events, columns=reading.WAITING.names), last, seen, forget)
        want = {}
        for u in {x[0] for x in events}:
            before, days = alone.setdefault(u, (None, {}))
            own = sorted(x[1:] for x in events if x[0] == u)
            want |= {(u, d): v for d, v in reading.added(before, days, own, forget).items()}
            alone[u] = ((own[-1][0], own[-1][2]), days)
        assert {(x[0], x[1]): list(x[2:]) for x in out.itertuples(index=False)} == want
    assert {(x.user, x.us, x.line) for x in last.itertuples()} == {(u, *v[0]) for u, v in alone.items()}


def test_calls_do_not_grow_with_readers():
    """handlers called the state store some ten times for each reader."""

    class State:
        calls = 0

        def __init__(self, value=None):
            self.value = value

        def __getattr__(self, name):
            def call(x=None):
                State.calls += 1
                if name == "appendValue":
                    self.value = (self.value or []) + [x]
                elif name in ("put", "update", "clear"):
                    self.value = x
                return self.value is not None if name == "exists" else self.value

            return call

    class Handle:
        getListState = getValueState = lambda self, *_: State()

        def registerTimer(self, ms):
            State.calls += 1

    class Time:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    taken = reading.Readers(400 * 86_400_000)
    taken.init(Handle())
    rows = pd.DataFrame([(u, 1_000_000 * k, k, "a", 1) for k in range(3) for u in range(500)], columns=reading.WAITING.names)
    assert list(taken.handleInputRows((0,), iter([rows]), Time(0))) == []
    (out,) = taken.handleExpiredTimer((0,), Time(10_000), None)
    assert len(out) == 500 and set(out["us"]) == {2_000_000} and State.calls < 30


def test_events_without_a_reader_are_one_reader(spark):
    got = played(spark, [(0, None, 0, 1, "a", 5), (1, None, 30, 2, "a", 7), (0, 0, 10, 3, "a", 1)])
    assert got[None, "2024-03-01"] == (30_000_000, 1, 5, 1) and got[0, "2024-03-01"] == (0, 1, 1, 1)
