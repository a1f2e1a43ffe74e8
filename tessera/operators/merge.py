"""Keyed tables: upserts, patches, cascades, and field-wise merges of two copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(base: DataFrame, new: DataFrame, key: list[str], clock: str) -> DataFrame:
    """The latest row of each key; at one time, the new table's."""
    rows = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(clock), F.desc("_new"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def patch(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the changes' fields that are not null; changes for absent keys do nothing."""
    fields = [c for c in changes.columns if c not in key]
    j = base.join(changes.select(*key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return j.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: list[str], keep: Column | None = None) -> DataFrame:
    """base without the keys' rows, but for those that keep holds."""
    gone = base.join(keys.select(*key).distinct(), key, "left_anti")
    return gone if keep is None else gone.unionByName(base.where(keep).join(keys.select(*key).distinct(), key, "left_semi").select(*base.columns))


def cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str, keep: dict[str, Column] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the keys' rows, and how many went from each."""
    left = {n: delete(t, keys, [key], (keep or {}).get(n)) for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.agg(F.count("*").alias("before")).crossJoin(left[n].agg(F.count("*").alias("after"))).select(F.lit(n).alias("name"), (F.col("before") - F.col("after")).alias("removed"))
        counts = c if counts is None else counts.unionByName(c)
    return left, counts


def insert_absent(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*key).distinct(), key, "left_anti").select(*base.columns))


def later_group(mine: str, theirs: str, clock: str, fields: list[str]) -> dict[str, Column]:
    """Fields that move together: the side whose clock is later gives them all."""
    theirs_is = F.col(f"{theirs}.{clock}") > F.coalesce(F.col(f"{mine}.{clock}"), F.lit(0))
    return {f: F.when(theirs_is, F.col(f"{theirs}.{f}")).otherwise(F.col(f"{mine}.{f}")) for f in [*fields, clock]}


def max_maps(a: Column, b: Column) -> Column:
    """Of two maps of numbers, the greater by key."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,double>")), F.coalesce(b, F.create_map().cast("map<string,double>")), lambda k, x, y: F.greatest(x, y))


def union_capped(a: Column, b: Column, most: int) -> Column:
    """In order, without repeats, at most so many."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))), 1, most)


def resolve(rows: DataFrame, targets: DataFrame, candidates: list[tuple[str, str]], out: str) -> DataFrame:
    """rows with ``out``, a target's id by the first candidate (row column, target column) that meets one."""
    found = []
    for i, (mine, theirs) in enumerate(candidates):
        by = targets.groupBy(theirs).agg(F.min(out).alias(f"_{i}"))
        rows = rows.join(by.withColumnRenamed(theirs, f"_k{i}"), F.col(mine) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_{i}"))
    return rows.withColumn(out, F.coalesce(*found)).withColumn("missing", F.col(out).isNull()).drop(*[f"_{i}" for i in range(len(candidates))])


def counts(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n"))


def recount(now: DataFrame, come: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Counts (key, n) after some rows came and some went; a key without any is gone."""
    change = counts(come, key).unionByName(counts(gone, key).withColumn("n", -F.col("n")))
    return now.unionByName(change).groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")


def same(a: Column, b: Column) -> Column:
    """Nested values that say the same: as JSON without nulls, a map's keys in order."""
    return F.to_json(F.parse_json(F.to_json(a))).eqNullSafe(F.to_json(F.parse_json(F.to_json(b))))
