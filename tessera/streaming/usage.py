"""Streams: daily usage with late data, and reading time by gap-capped sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

GAP_US, DAY_US = 120_000_000, 86_400_000_000


def events(spark: SparkSession, folder: str, schema: StructType | str, files: int = 2) -> DataFrame:
    """A folder of Parquet files as a stream, some files at a time; zone-less times become session-zone times."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n, total; events up to ``late`` behind the newest still count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def once_a_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The first of a user's events of one type a day, whichever batch it comes in."""
    return stream.withWatermark("ts", late).withColumn("day", F.to_date("ts")).dropDuplicatesWithinWatermark(["day", "user_id", "event_type"])


def reading(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, day, us: time between a user's events in order, each gap capped, split at midnight. State is a user's last time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out: dict[int, int] = {}
        us = sorted(int(x) for f in frames for x in f["us"])
        for t in us:
            if last is not None and t > last:
                end = min(t, last + GAP_US)
                a = last
                while a < end:
                    b = min(end, (a // DAY_US + 1) * DAY_US)
                    out[a // DAY_US] = out.get(a // DAY_US, 0) + b - a
                    a = b
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "day": list(out), "us": list(out.values())})

    rows = stream.withWatermark("ts", late).select("user_id", F.unix_micros("ts").alias("us"))
    parts = rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, day long, us long", "last long", "append", GroupStateTimeout.NoTimeout)
    return parts.select("user_id", F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "us")


def run_to_table(out: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over what is there, into a table in memory (tests, small results)."""
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


def additive_sink(path: str):
    """A foreachBatch function that writes each batch's increments under its id: a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
