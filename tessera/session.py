"""Session construction and table loading shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that every query may rely on. Nothing here depends on the size of the data.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys use ``__`` in place of dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver's copy lies; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        at = os.path.realpath(tempfile.mkdtemp(prefix="tessera-"))  # the driver serves the file while it lives
        atexit.register(shutil.rmtree, at, True)
        shutil.copytree(here, f"{at}/in/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/tessera", "zip", f"{at}/in"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder; zone-less timestamps become session-zone timestamps."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over tasks of about so many rows, one for each core at least. Stages by these keys need no other
    shuffle, and their tasks stay as large when the table grows; a small file of many rows is not one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def work_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, a new local one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def filesystem(spark: SparkSession, folder: str):
    """(file system, path maker) of a folder, for what DataFrames do not do: listing, renaming, deleting."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder in work_dir() that goes when the program ends."""
    at = f"{work_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            fs, path = filesystem(spark, at)
            fs.delete(path(at), True)
        except Exception:  # the session has gone
            pass

    atexit.register(remove)
    return at


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to work_dir() and read again: what follows starts from them, whatever executors are lost."""
    at = new_folder(df.sparkSession, "stored")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
