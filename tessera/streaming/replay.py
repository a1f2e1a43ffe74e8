"""A table played as a stream: files that are read one after another, with an end that moves the watermark past all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import filesystem, new_folder

#: Files of a slice.
FILES = 2


def slices(df: DataFrame, at: Column, n: int, end: dict[str, Column] | None = None) -> str:
    """Writes ``df`` as n slices of ``at`` (0 to 1), rows of a slice in no order. ``end`` gives the columns of one more row,
    the last that is read. Files are read in order of their times, so these are set by slice."""
    spark = df.sparkSession
    folder = new_folder(spark, "replay")
    rows = df.withColumn("_slice", F.least(F.floor(at * n), F.lit(n - 1)).cast("int"))
    if end:
        rows = rows.unionByName(spark.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema), F.lit(n).alias("_slice")))
    rows.repartition(n * FILES, "_slice", F.floor(F.rand(1) * FILES)).write.partitionBy("_slice").parquet(folder)
    fs, path = filesystem(spark, folder)
    first = min(x.getModificationTime() for x in fs.listStatus(path(folder)))
    for i in range(n + 1):
        if fs.exists(path(f"{folder}/_slice={i}")):
            for x in fs.listStatus(path(f"{folder}/_slice={i}")):  # FILES of them
                fs.setTimes(x.getPath(), first + 1000 * i, -1)
    return folder


def play(folder: str, schema, through: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes the slices through a streaming plan into a sink of (batch, id), a slice's file at a time, and waits for the end."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder).drop("_slice")
    out = through(stream).writeStream.outputMode(mode).option("checkpointLocation", new_folder(spark, "replay-state"))
    out.trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
