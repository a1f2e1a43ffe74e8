"""Sets of whole-number ranges, both ends inside; ranges that touch are one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union(df: DataFrame, key: str | list[str], lo: str, hi: str) -> DataFrame:
    """(key, lo, hi): merged ranges of each key (or of each value of several columns); a range given backwards is turned."""
    keys = [key] if isinstance(key, str) else key
    r = df.select(*keys, F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))
    w = Window.partitionBy(*keys).orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = r.select(*keys, "lo", F.lag("lo").over(w).alias("_prev"), F.lead("lo").over(w).alias("_next"), reach.alias("hi"))
    # one sort does it all: a merged range begins where no earlier one reaches, and ends where none begins in reach
    first = F.col("_prev").isNull() | (F.col("lo") > F.lag("hi").over(w) + 1)
    r = r.withColumn("_first", first).withColumn("_last", F.col("_next").isNull() | (F.col("_next") > F.col("hi") + 1))
    begun = F.last(F.when(F.col("_first"), F.col("lo")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.select(*keys, begun.alias("lo"), "hi", "_last").where("_last").drop("_last")


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): what of a's ranges is in none of b's. Both hold (key, lo, hi); one sweep over their edges."""
    turned = lambda df: df.select(key, F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    a, b = turned(a), turned(b)  # ranges that overlap are counted, so nothing need be merged first
    edge = lambda df, da, db: df.select(key, F.col("lo").alias("at"), F.lit(da).alias("da"), F.lit(db).alias("db")).unionByName(df.select(key, (F.col("hi") + 1).alias("at"), F.lit(-da).alias("da"), F.lit(-db).alias("db")))
    e = edge(a, 1, 0).unionByName(edge(b, 0, 1))
    w = Window.partitionBy(key).orderBy("at")
    run = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # edges at one place count together
    e = e.select(key, F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("da").over(run).alias("in_a"), F.sum("db").over(run).alias("in_b"))
    return union(e.where("in_a > 0 AND in_b = 0 AND hi >= lo").select(key, "lo", "hi"), key, "lo", "hi")


def contains(points: DataFrame, ranges: DataFrame, key: str, at: str) -> DataFrame:
    """points with ``inside``: a point is inside if the last range that begins at or before it reaches it."""
    r = union(ranges, key, "lo", "hi")
    both = points.select(key, F.col(at).alias("at"), F.lit(None).cast("bigint").alias("reach"), F.lit(1).alias("point")).unionByName(r.select(key, F.col("lo").alias("at"), F.col("hi").cast("bigint").alias("reach"), F.lit(0).alias("point")))
    w = Window.partitionBy(key).orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("reach", F.max("reach").over(w)).where("point = 1")
    return both.select(key, F.col("at").alias(at), F.coalesce(F.col("reach") >= F.col("at"), F.lit(False)).alias("inside"))


def length(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    return union(df, key, lo, hi).groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))


def until_same_level(heads: DataFrame, key: str, at: str, level: str, levels: int = 5) -> DataFrame:
    """heads with ``until``: the place before the next heading of its level or above, null for the last. For each level, one
    running minimum from the end, so no heading meets all others."""
    back = Window.partitionBy(key).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    until = F.lit(None).cast("long")
    for n in range(1, levels + 1):
        until = F.when(F.col(level) == n, F.min(F.when(F.col(level) <= n, F.col(at))).over(back) - 1).otherwise(until)
    return heads.withColumn("until", until)


def chapter_of(points: DataFrame, heads: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """points with chapter (its number from 0, -1 before the first), lo and hi (null for the last): chapters go from one
    heading to the next, and of headings at one place one counts. One sweep over points and headings together."""
    none = F.lit(None).cast("long")
    h = heads.select(key, F.col(start).cast("long").alias("_at")).distinct()
    w = Window.partitionBy(key).orderBy("_at")
    h = h.select(key, "_at", F.row_number().over(w).cast("long").alias("_n"), F.col("_at").alias("_lo"), (F.lead("_at").over(w) - 1).alias("_hi"), F.lit(0).alias("_point"))
    p = points.select(key, F.col(at).cast("long").alias("_at"), none.alias("_n"), none.alias("_lo"), none.alias("_hi"), F.lit(1).alias("_point"))
    run = Window.partitionBy(key).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("_point") == 0, F.struct("_n", "_lo", "_hi"))).over(run)
    first = F.min("_lo").over(Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_point")).rowsBetween(Window.unboundedPreceding, 0))  # before the first heading, a page's stretch ends at it
    both = h.unionByName(p).withColumn("_last", last).withColumn("_next", first).where("_point = 1")
    return both.select(key, F.col("_at").alias(at), F.coalesce(F.col("_last._n") - 1, F.lit(-1).cast("long")).alias("chapter"), F.col("_last._lo").alias("lo"), F.when(F.col("_last").isNull(), F.col("_next") - 1).otherwise(F.col("_last._hi")).alias("hi"))


def marked(read: DataFrame, marks: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Read ranges (key, lo, hi) after some were marked as read or unread (key, lo, hi, on); marks of keys that are not live do
    nothing."""
    m = marks.join(live.select(key).distinct(), key, "left_semi")
    more = read.select(key, "lo", "hi").unionByName(m.where("on").select(key, "lo", "hi"))
    return subtract(more, m.where("NOT on").select(key, "lo", "hi"), key)
