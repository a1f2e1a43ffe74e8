"""A folder of keyed tables that change together: every transaction writes new files beside the old ones, then one small
file that names which files are the tables now. Readers see all of a transaction or nothing; of two writers one fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import merge


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # which files are the tables now

    def _versions(self) -> list[int]:
        p = self._hadoop(f"{self.path}/_tables")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(p) if x.getPath().getName().isdigit()) if self.fs.exists(p) else []

    def _state(self) -> tuple[int, dict[str, dict]]:
        v = self._versions()
        if not v:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/_tables/{v[-1]}", wholetext=True).first()[0]
        return v[-1], json.loads(text)

    def _put(self, version: int, state: dict[str, dict]) -> None:
        at = self._hadoop(f"{self.path}/_tables/{version}")
        try:
            out = self.fs.create(at, False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"version {version} has been written") from e
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()

    def ensure(self, schemas: dict[str, StructType]) -> list[str]:
        """Makes the tables that are missing, empty; tells which."""
        new = [n for n in schemas if n not in self._state()[1]]
        if new:
            self.write({n: self.spark.createDataFrame([], schemas[n]) for n in new})
        return new

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Replaces tables, all in one transaction; tells its number. What is read from this store before stays readable."""
        version, state = self._state()
        for name, df in tables.items():
            at = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{at}")
            state[name] = {"at": at, "schema": df.schema.json()}
        self._put(version + 1, state)
        return version + 1

    def table(self, name: str) -> DataFrame:
        t = self._state()[1][name]
        return self.spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{self.path}/{t['at']}")

    def names(self) -> list[str]:
        return sorted(self._state()[1])

    def get(self, name: str, key: str, value) -> DataFrame:
        return self.table(name).where(F.col(key).eqNullSafe(F.lit(value)))

    def count(self, name: str) -> int:
        return self.table(name).count()

    def keys(self, name: str, key: list[str]) -> DataFrame:
        return self.table(name).select(*key).distinct()

    def upsert(self, name: str, rows: DataFrame, key: list[str], clock: str) -> int:
        return self.write({name: merge.upsert(self.table(name), rows, key, clock)})

    def clear(self, name: str) -> int:
        return self.write({name: self.table(name).limit(0)})

    def batches(self, name: str, key: str, size: int) -> Iterator[DataFrame]:
        """The table in key order, some rows at a time, for a consumer that must go step by step; nothing is collected."""
        t, after = self.table(name), None
        while True:
            rest = t if after is None else t.where(F.col(key) > after)
            now = rest.orderBy(key).limit(size)
            last = now.agg(F.max(key)).first()[0]
            if last is None:
                return
            yield now
            after = last

    def vacuum(self) -> int:
        """Removes files that no table is any more; tells how many tables' files went."""
        version, state = self._state()
        live, gone = {t["at"] for t in state.values()}, 0
        for name in state:
            for x in self.fs.listStatus(self._hadoop(f"{self.path}/{name}")):
                if f"{name}/{x.getPath().getName()}" not in live:
                    self.fs.delete(x.getPath(), True)
                    gone += 1
        for v in self._versions():
            if v < version:
                self.fs.delete(self._hadoop(f"{self.path}/_tables/{v}"), False)
        return gone


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", empty: tuple[str, ...] = ("", "NA", "NaN", "null"), decimal_comma: bool = False, date: str | None = None) -> DataFrame:
    """A CSV file with a header: only the schema's columns, in any order of the file; words that mean nothing are null, and what
    is not of a column's type is null and counted in ``_bad``."""
    want = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)

    def typed(f):
        text = F.when(~F.trim(F.col(f"`{f.name}`")).isin(*empty), F.trim(F.col(f"`{f.name}`")))
        if f.dataType.typeName() in ("double", "decimal") and decimal_comma:
            text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        got = F.to_date(F.try_to_timestamp(text, F.lit(date))) if date and f.dataType.typeName() == "date" else text.try_cast(f.dataType)
        return text, got.alias(f.name)

    cols = [typed(f) for f in want.fields]
    bad = sum((F.when(t.isNotNull() & g.isNull(), 1).otherwise(0) for t, g in cols[1:]), F.when(cols[0][0].isNotNull() & cols[0][1].isNull(), 1).otherwise(0))
    return raw.select(*[g for _, g in cols], bad.alias("_bad"))
