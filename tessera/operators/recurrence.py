"""Exponentially weighted means: a linear recurrence over ordered rows, by blocks.

A block of rows is one affine map: it takes the sum before it to that sum times a power, plus the block's own. Maps compose,
so only one row a block is put in order to find what each block starts from, and no task sees more than a block's rows or a
key's blocks. Rows are dealt into ranges of (key, order), which part a key that is too large for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stored

BLOCK = 512


def ewm(rows: DataFrame, key: list[str], order: list[str], value: str, alpha: float, adjust: bool = True, block: int = BLOCK) -> DataFrame:
    """rows (which keep their columns) with ``ewm``: the mean of the values so far, each weighted by (1 - alpha) to the number
    of rows since, as pandas has it: with ``adjust`` the weights' sum divides, else the first value counts as the mean before
    it. A null value adds nothing, and its row carries the mean on; with ``adjust`` it counts among the rows since, else not
    (pandas' ignore_na). Before the first value the mean is null, and after so many nulls in a row that no double holds
    their weight. ``alpha`` is between 0 and 1."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    r = 1.0 - alpha
    parted = rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id())
    parted = stored(parted.select(F.struct(*rows.columns).alias("_row"), "_part", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.struct(*order).alias("_o"), F.col(value).cast("double").alias("_x")))
    ks = [f"_k{i}" for i in range(len(key))]
    n = F.row_number().over(Window.partitionBy(*ks, "_part").orderBy("_o")) - 1
    blocks = parted.withColumn("_block", F.floor(n / block)).groupBy(*ks, "_part", "_block")
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("_o", "_x", "_row"))).alias("_rows"))  # ``block`` rows at most
    if adjust:
        weight = F.lit(1.0)
    else:  # the first value of all weighs 1, later ones alpha
        first = parted.where("_x IS NOT NULL").groupBy(*ks).agg(F.min("_o").alias("_first"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ks]
        blocks = blocks.alias("a").join(first.alias("c"), same, "left").select("a.*", "c._first")
        weight = None

    def step(acc: Column, x: Column) -> Column:
        w = weight if weight is not None else F.when(x["_o"] == F.col("_first"), 1.0).otherwise(alpha)
        has = x["_x"].isNotNull()
        by = F.lit(r) if adjust else F.when(has, r).otherwise(1.0)
        top = acc["top"] * by + F.when(has, x["_x"] * w).otherwise(0.0)
        below = acc["below"] * by + F.when(has, w).otherwise(0.0)
        size = acc["size"] * by
        return F.struct(top.alias("top"), below.alias("below"), size.alias("size"), F.concat(acc["all"], F.array(F.struct(top.alias("t"), below.alias("b"), size.alias("s")))).alias("all"))

    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("below"), F.lit(1.0).alias("size"), F.array().cast("array<struct<t:double,b:double,s:double>>").alias("all"))
    blocks = stored(blocks.withColumn("_f", F.aggregate("_rows", zero, step)).drop(*(["_first"] if not adjust else [])))
    ends = blocks.select(*ks, F.struct("_part", "_block").alias("_at"), F.col("_f.top").alias("t"), F.col("_f.below").alias("b"), F.col("_f.size").alias("s"))
    line = ends.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("_at", "t", "b", "s"))).alias("_line"))  # a row a block
    begin = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("b"), F.array().cast("array<struct<t:double,b:double>>").alias("all"))
    going = lambda acc, x: F.struct((acc["t"] * x["s"] + x["t"]).alias("t"), (acc["b"] * x["s"] + x["b"]).alias("b"), F.concat(acc["all"], F.array(F.struct(acc["t"].alias("t"), acc["b"].alias("b")))).alias("all"))
    before = line.select(*ks, F.explode(F.arrays_zip(F.col("_line._at").alias("at"), F.aggregate("_line", begin, going)["all"].alias("in"))).alias("z")).select(*ks, "z.at._part", "z.at._block", F.col("z.in").alias("_in"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*ks, "_part", "_block"]]
    j = blocks.alias("a").join(before.alias("c"), same).select("a._rows", "a._f", "c._in")
    out = j.select("_in", F.explode(F.arrays_zip(F.col("_rows._row").alias("row"), F.col("_f.all").alias("f"))).alias("z"))
    top, below = F.col("_in.t") * F.col("z.f.s") + F.col("z.f.t"), F.col("_in.b") * F.col("z.f.s") + F.col("z.f.b")
    return out.select("z.row.*", F.when(below > 0, top / below).alias("ewm"))
