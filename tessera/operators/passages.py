"""Which paragraphs to send next under a budget of characters: an order, and a fold that skips what does not fit and goes on.

Paragraphs that were sent less often come first, then those with a summary, then all pages in turn: a round takes one
paragraph of each page, pages that gave least so far first, then in an order that spreads over the book.

Only few paragraphs can be among the chosen, so no task folds a whole book. Of a size class (2^c to 2^(c+1) characters)
the first budget / 2^c may all be taken. After them either the budget is spent or one of them was skipped, so that less than
2^(c+1) is left, of which the class can take one paragraph more; and one that has a shorter or equal one of its class before
it, among so many, is skipped if that one was, and has no room if that one was taken. So the first ones and the falling
minima of each class are all that the fold needs; what is not, is dropped where it lies, then once more where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 8000


def spread(n: Column) -> Column:
    """Places 0, 1, 2, 3 ... as 0, 1/2, 1/4, 3/4 ...: the bits of the number, turned about its point."""
    return F.conv(F.reverse(F.lpad(F.bin(n), 30, "0")), 2, 10).cast("double") / float(1 << 30)


def ordered(paras: DataFrame, key: str) -> DataFrame:
    """paras (key, page, para, pos, sent, summarised, candidate) that are candidates, with ``turn``: what they are ordered by.
    ``sent`` counts how often a paragraph was sent, of others too: a page's sum is its load."""
    load = paras.groupBy(key, "page").agg(F.sum("sent").alias("_load"))
    c = paras.where("candidate").withColumn("_group", F.col("sent") * 2 + F.when(F.col("summarised"), 0).otherwise(1))
    pages = c.select(key, "_group", "page").distinct()
    pages = pages.withColumn("_page", F.row_number().over(Window.partitionBy(key, "_group").orderBy("page")) - 1).join(load, [key, "page"])
    c = c.withColumn("_round", F.row_number().over(Window.partitionBy(key, "_group", "page").orderBy("pos")))
    turn = F.struct("_group", "_round", "_load", spread(F.col("_page")).alias("spread"), "_page")
    return c.join(pages, [key, "_group", "page"]).withColumn("turn", turn).drop("_group", "_round", "_load", "_page")


def _needed(rows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Rows that the fold may take, as said above, of each ``by`` and size class."""
    size = F.floor(F.log2(F.greatest("chars", F.lit(1)))).cast("int")
    w = Window.partitionBy(*by, "_class").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_class", size).withColumn("_n", F.row_number().over(w)).withColumn("_least", F.min("chars").over(before))
    first = F.col("_n") <= F.floor(F.lit(budget) / F.pow(F.lit(2.0), F.col("_class"))) + 1
    return rows.where(first | (F.col("chars") < F.col("_least"))).drop("_class", "_n", "_least")


def chosen(rows: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """key, place, para, page, total, left: rows (key, page, para, chars, turn) in the order of ``turn``, each taken if it still
    fits ``budget`` and else skipped; ``total`` counts characters up to and with it, ``left`` rows that were not taken. Rows of
    no characters are always taken. A key of which nothing fits has no row."""
    fits = rows.where(F.col("chars").between(1, budget)).select(key, "page", "para", "chars", "turn")
    some = _needed(_needed(fits.withColumn("_part", F.spark_partition_id()), [key, "_part"], budget).drop("_part"), [key], budget)
    empty = rows.where(F.coalesce("chars", F.lit(0)) == 0).select(key, "page", "para", F.lit(0).alias("chars"), "turn")
    item = F.struct("turn", F.col("chars").cast("long").alias("chars"), "para", "page")
    listed = some.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_rows"))  # bounded by the budget
    none = F.expr("slice(_rows, 1, 0)")
    step = lambda acc, x: F.when(acc["used"] + x["chars"] <= budget, F.struct((acc["used"] + x["chars"]).alias("used"), F.concat(acc["took"], F.array(x)).alias("took"))).otherwise(acc)
    took = listed.select(key, F.explode(F.aggregate("_rows", F.struct(F.lit(0).cast("long").alias("used"), none.alias("took")), step)["took"]).alias("x")).select(key, "x.*")
    took = took.unionByName(empty.select(key, "turn", F.col("chars").cast("long").alias("chars"), "para", "page"))
    w = Window.partitionBy(key).orderBy("turn")
    counts = rows.groupBy(key).agg(F.count("*").alias("_all"))
    out = took.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum("chars").over(w)).join(counts, key)
    return out.select(key, "place", "para", "page", "total", (F.col("_all") - F.count("*").over(Window.partitionBy(key))).alias("left"))
