"""The reading log as a stream: time between a reader's events, lines and pages, whatever order the events come in.

Events wait in state until the watermark has passed them, so all that can still come before them has come; an event-time
timer then takes the waiting events in order. What is left of a reader is one time and line, and the day each page was
last counted on, and goes when the reader has been away for ``forget``. Readers share state and timers by groups, so
that a batch costs calls for each group, not for each reader. Results are increments: a batch that runs again replaces
its own (sink()), and their sums are the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

GAP_US, DAY_US = 120_000_000, 86_400_000_000
#: Rows of the log: what a reader adds to a day.
LOG = "user_id long, day int, us long, lines long, amount long, pages long"
#: What is kept of a group: waiting events; each reader's last time and line; the day each page was last counted on.
_LONG, _TEXT = pa.int64(), pa.string()
WAITING = pa.schema({"user": _LONG, "us": _LONG, "id": _LONG, "line": _TEXT, "amount": _LONG})
LAST = pa.schema({"user": _LONG, "us": _LONG, "line": _TEXT})
SEEN = pa.schema({"user": _LONG, "line": _TEXT, "day": _LONG})


def added(last: tuple[int, str] | None, seen: dict[str, int], events: list[tuple[int, int, str, int]], forget_us: int | None = None) -> dict[int, list[int]]:
    """What events (us, id, line, amount), in order, add to each day, after the last one (us, line): time since the one
    before, GAP_US at most, split at midnight; lines (and their amounts) that differ from the one before; pages, each once
    a day. A reader who comes back after ``forget_us`` begins anew. ``seen``, the day on which each page was last counted, is
    kept up to date."""
    days: dict[int, list[int]] = {}
    for us, _, line, amount in events:
        if last and forget_us and us - last[0] >= forget_us:
            last = None
        if last:
            at, end = last[0], min(us, last[0] + GAP_US)
            while at < end:
                cut = min(end, (at // DAY_US + 1) * DAY_US)
                days.setdefault(at // DAY_US, [0, 0, 0, 0])[0] += cut - at
                at = cut
        day = us // DAY_US
        if not last or last[1] != line:
            own = days.setdefault(day, [0, 0, 0, 0])
            own[1] += 1
            own[2] += amount
        if seen.get(line) != day:
            seen[line] = day
            days.setdefault(day, [0, 0, 0, 0])[3] += 1
        last = (us, line)
    return days


def taken(events: pd.DataFrame, last: pd.DataFrame, seen: pd.DataFrame, forget_us: int | None = None) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """added() for many readers at once: the log (user, day, us, lines, amount, pages) of events (WAITING), and LAST and SEEN
    after them."""
    e = events.sort_values(["user", "us", "id", "line", "amount"])
    e = e.assign(day=e["us"] // DAY_US)
    rows = pd.concat([last.assign(new=False), e.assign(new=True)]).sort_values("user", kind="stable")
    user, us, line, new = (rows[c].to_numpy() for c in ("user", "us", "line", "new"))
    same = np.zeros(len(rows), bool)
    same[1:] = user[1:] == user[:-1]
    before = np.roll(us, 1)
    same &= new
    if forget_us:
        same &= us - before < forget_us
    changed = new & ~(same & (line == np.roll(line, 1)))
    start, end = before[same], np.minimum(us[same], before[same] + GAP_US)
    day = start // DAY_US
    cut = np.minimum(end, (day + 1) * DAY_US)
    pages = pd.concat([seen.assign(new=False), e[["user", "line", "day"]].assign(new=True)])
    first = pages[pages["new"] & ~pages.duplicated(["user", "line", "day"])]
    parts = [
        pd.DataFrame({"user": user[same], "day": day, "us": cut - start}),
        pd.DataFrame({"user": user[same], "day": day + 1, "us": end - cut}),
    ]
    parts = [x[x["us"] > 0].assign(lines=0, amount=0, pages=0) for x in parts]
    own = rows[changed]
    parts.append(pd.DataFrame({"user": own["user"], "day": own["day"].astype("int64"), "us": 0, "lines": 1, "amount": own["amount"].astype("int64"), "pages": 0}))
    parts.append(pd.DataFrame({"user": first["user"], "day": first["day"], "us": 0, "lines": 0, "amount": 0, "pages": 1}))
    out = pd.concat(parts).groupby(["user", "day"], as_index=False).sum()
    return out, rows.drop_duplicates("user", keep="last")[LAST.names], pages.drop_duplicates(["user", "line"], keep="last")[SEEN.names]


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(packs: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(x).read_all() for x in packs)]).to_pandas()


class Readers(StatefulProcessor):
    """The readers of a group; those without a user (a group of their own, whose key is null) are one reader."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getValueState("known", "last binary, seen binary")
        self.done = handle.getValueState("done", "passed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()  # what is older may belong before events that have been taken
        new = pd.concat([f[WAITING.names] for f in rows])
        new = new[new["us"] // 1000 >= passed]
        if len(new):
            self.waiting.appendValue((_packed(new, WAITING),))
            self.handle.registerTimer(int(new["us"].min()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done.exists() and self.done.get()[0] == passed:  # another timer of this batch has taken all
            return
        waiting = _unpacked([x[0] for x in self.waiting.get()] if self.waiting.exists() else [], WAITING)
        last, seen = ([x] for x in self.known.get()) if self.known.exists() else ([], [])
        ready = waiting["us"] // 1000 < passed
        out, last, seen = taken(waiting[ready], _unpacked(last, LAST), _unpacked(seen, SEEN), self.forget_ms * 1000)
        gone = last["us"] // 1000 + self.forget_ms < passed  # whatever comes now comes too late to go on
        if gone.any():
            seen = seen[~seen["user"].isin(last["user"][gone])]
            last = last[~gone]
        later = waiting[~ready]
        if ready.any():
            self.waiting.clear()
            if len(later):
                self.waiting.put([(_packed(later, WAITING),)])
        due = [int(later["us"].min()) // 1000 + 1] if len(later) else []
        if len(last):
            self.known.update((_packed(last, LAST), _packed(seen, SEEN)))
            due.append(int(last["us"].min()) // 1000 + self.forget_ms + 1)
        else:
            self.known.clear()
        if due:
            self.done.update((passed,))
        else:
            self.done.clear()
        for at in due:
            self.handle.registerTimer(at)
        if len(out):
            yield out.assign(user=None if key[0] is None else out["user"]).rename(columns={"user": "user_id"})

    def close(self) -> None:
        pass


def log(stream: DataFrame, late: str = "3 days", forget_days: int = 400, groups: int = 512) -> DataFrame:
    """Increments (user_id, day, us, lines, amount, pages) of events (user_id, ts, id, line, amount). Events up to ``late``
    behind the newest are taken in order, later ones are dropped; the gap before a return after ``forget_days`` is not
    counted. ``groups`` of readers should be no fewer than tasks. Needs the RocksDB state store (state_store())."""
    rows = stream.withWatermark("ts", late).where("ts IS NOT NULL").select(F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(groups))).alias("group"), "ts", F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.unix_micros("ts").alias("us"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("line", F.lit("")).alias("line"), F.coalesce("amount", F.lit(0)).cast("long").alias("amount"))
    out = rows.groupBy("group").transformWithStateInPandas(Readers(forget_days * 86_400_000), LOG, "append", "EventTime")
    return out.withColumn("day", F.date_from_unix_date("day"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for the streams started inside."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def totals(increments: DataFrame) -> DataFrame:
    """The log: increments summed by reader and day."""
    return increments.groupBy("user_id", "day").agg(*(F.sum(c).alias(c) for c in ("us", "lines", "amount", "pages")))
