"""Ingest of rows with what is derived from them: both in one commit under the batch's id, and made anew by version.

A batch writes the rows, what was derived from them and a mark for each key into one folder named by its id, in one job:
either all of it is there or nothing, and a batch that runs again replaces its own. Of the batches that hold a key the
newest counts, for the row and for what is derived. Kinds of rows are a column, not folders: folders would have a task sort
all that it derives, and the kinds lie in files of their own anyway. Newest keys are hashed, so nothing derived is sorted to
be read either. When the rules change, so does ``version``: keys without a mark of it
are found by an anti-join and only these are derived again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import filesystem


class Ingest:
    """Tables under ``folder``: base (``schema``, with ``key``) and derived (``derived_schema``, with ``key``). ``derive`` makes
    any number of derived rows out of base rows. A base row whose column ``removed`` is true takes its key away. Rows of one
    key in one batch: the greatest of ``order`` counts. Keys are not null; rows without one are left out."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, derive: Callable[[DataFrame], DataFrame], derived_schema: str, version: str, order: str | None = None):
        self.spark, self.folder, self.key, self.derive, self.version, self.order = spark, folder, key, derive, version, order
        self.base_type, self.derived_type = f"struct<{_fields(schema)}>", f"struct<{_fields(derived_schema)}>"
        self.removed = "removed" in [x.split(" ")[0] for x in schema.split(", ")]

    def _rows(self, base: DataFrame) -> DataFrame:
        """Base, derived and mark rows in one form."""
        alive = base.where(~F.coalesce("removed", F.lit(False))) if self.removed else base
        none_base, none_derived = F.lit(None).cast(self.base_type), F.lit(None).cast(self.derived_type)
        struct = lambda df, kind: F.struct(*df.columns).cast(kind)
        k = F.col(self.key).cast("string").alias("k")
        derived = self.derive(alive)
        made = derived.select(k, F.lit("derived").alias("what"), none_base.alias("base"), struct(derived, self.derived_type).alias("derived"))
        return made.unionByName(alive.select(k, F.lit("mark").alias("what"), none_base.alias("base"), none_derived.alias("derived")))

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        base = batch.where(F.col(self.key).isNotNull())
        if self.order:
            last = base.groupBy(self.key).agg(F.max_by(F.struct(*base.columns), self.order).alias("_x"))
            base = last.select("_x.*")
        k = F.col(self.key).cast("string").alias("k")
        own = base.select(k, F.lit("base").alias("what"), F.struct(*base.columns).cast(self.base_type).alias("base"), F.lit(None).cast(self.derived_type).alias("derived"))
        self._write(own.unionByName(self._rows(base)), "main", batch_id)

    def _write(self, rows: DataFrame, run: str, batch_id: int) -> None:
        rows.withColumn("version", F.when(F.col("what") == "base", "-").otherwise(self.version)).write.mode("overwrite").parquet(f"{self.folder}/run={run}/batch={batch_id}")

    def _read(self, what: str) -> DataFrame:
        fs, path = filesystem(self.spark, self.folder)
        schema = f"k string, what string, base {self.base_type}, derived {self.derived_type}, version string, run string, batch long"
        if not fs.exists(path(self.folder)):
            return self.spark.createDataFrame([], schema).where(F.col("what") == what)
        return self.spark.read.schema(schema).parquet(self.folder).where(F.col("what") == what)

    def _newest(self) -> DataFrame:
        return self._read("base").groupBy("k").agg(F.max("batch").alias("batch"))

    def base(self) -> DataFrame:
        """The newest row of each key."""
        out = self._read("base").join(self._newest().hint("shuffle_hash"), ["k", "batch"], "left_semi").select("base.*")
        return out.where(~F.coalesce("removed", F.lit(False))) if self.removed else out

    def derived(self) -> DataFrame:
        """What is derived, by this version's rules, from the newest row of each key."""
        return self._derived().join(self._newest().hint("shuffle_hash"), ["k", "batch"], "left_semi").select("derived.*")

    def _derived(self) -> DataFrame:
        return self._read("derived").where(F.col("version") == self.version)

    def derived_at_most(self) -> int:
        """How many rows derived() has, or more: those of older rows of a key count too, so nothing is joined."""
        return self._derived().count()

    def stale(self) -> DataFrame:
        """k, batch: keys whose newest row nothing is derived from by this version's rules."""
        marks = self._read("mark").where(F.col("version") == self.version).select("k", "batch")
        gone = self._read("base").where("base.removed").select("k", "batch") if self.removed else None
        out = self._newest().join(marks, ["k", "batch"], "left_anti")
        return out.join(gone, ["k", "batch"], "left_anti") if gone is not None else out

    def recompute(self) -> None:
        """Derives what is stale, batch by batch of its origin; running again finds nothing left to do."""
        stale = self.stale()
        for (n,) in stale.select("batch").distinct().orderBy("batch").collect():  # as many as batches not yet made over
            rows = self._read("base").where(F.col("batch") == n).join(stale, ["k", "batch"], "left_semi").select("base.*")
            self._write(self._rows(rows), self.version, n)


def _fields(schema: str) -> str:
    return ", ".join(f"{x.split(' ', 1)[0]}: {x.split(' ', 1)[1]}" for x in schema.split(", "))
