"""Study plans and queues: what is left, how fast, what is due, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import let

#: Days a speed is measured over, the least time for it, characters a minute where it cannot be, a page's characters
#: where none is known, days of slack below which a plan is tight.
SPEED_DAYS, MEASURED_MS, DEFAULT_CPM, PAGE_CHARS, TIGHT = 14, 30 * 60 * 1000, 840.0, 1800.0, 2


def remaining(pages: DataFrame, read: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """key, total, done, left out of pages (key, page, chars or null) and read (key, page): a page whose size is not known
    counts as its document's mean. With ``order`` (columns of pages) sizes are added as doubles in that order, as a loop
    over the pages does; without, halves are exact in whatever order the rows come."""
    p = pages.join(read.select(key, "page", F.lit(1).alias("r")).distinct(), [key, "page"], "left")
    known, done = F.col("chars").isNotNull(), F.col("r").isNotNull()
    if order:
        rows = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("chars").cast("double").alias("c"), done.alias("d")))).alias("_x"))
        add = lambda xs, c: F.aggregate(xs, F.lit(0.0), lambda a, x: a + c(x))
        sized = rows.withColumn("_k", F.filter("_x", lambda x: x["c"].isNotNull()))
        mean = F.coalesce(F.when(F.size("_k") > 0, add("_k", lambda x: x["c"]) / F.size("_k")), F.lit(PAGE_CHARS))
        of = lambda xs: F.floor(add(xs, lambda x: F.coalesce(x["c"], F.col("_m"))) + 0.5)
        sums = sized.withColumn("_m", mean).select(key, of("_x").alias("total"), of(F.filter("_x", lambda x: x["d"])).alias("done"))
        return sums.withColumn("left", F.greatest(F.lit(0), F.col("total") - F.col("done")))
    g = p.groupBy(key).agg(
        F.coalesce(F.sum("chars"), F.lit(0.0)).alias("s"), F.count("chars").alias("n"), F.count_if(~known).alias("u"),
        F.coalesce(F.sum(F.when(done, F.col("chars"))), F.lit(0.0)).alias("rs"), F.count_if(done & ~known).alias("ru"),
    )
    # sums of whole numbers, and one division at the end: a half is a half in whatever order the rows come
    half_up = lambda own, of: F.when(F.col("n") > 0, F.floor((2 * (own * F.col("n") + F.col("s") * of) + F.col("n")) / (2 * F.col("n")))).otherwise(F.floor(PAGE_CHARS * of + 0.5))
    return g.select(key, half_up(F.col("s"), F.col("u")).alias("total"), half_up(F.col("rs"), F.col("ru")).alias("done")).withColumn("left", F.greatest(F.lit(0), F.col("total") - F.col("done")))


def speed(log: DataFrame, key: str, today: Column) -> DataFrame:
    """key, cpm, measured out of (key, day, ms, chars): characters a minute over the last days, or the default."""
    g = log.where((F.col("day") <= today) & (F.col("day") > F.date_sub(today, SPEED_DAYS))).groupBy(key).agg(F.sum("ms").alias("ms"), F.sum("chars").alias("chars"))
    known = (F.col("ms") >= MEASURED_MS) & (F.col("chars") > 0)
    return g.select(key, F.when(known, F.col("chars") / (F.col("ms") / 60000.0)).otherwise(DEFAULT_CPM).alias("cpm"), known.alias("measured"))


def plan_status(left: Column, days: Column, day_chars: Column) -> Column:
    """done, short, tight or ok, by the study days that are over when all is read."""
    slack = days - F.ceil(left / day_chars)
    return F.when(left <= 0, "done").when((days <= 0) | (day_chars <= 0) | (slack < 0), "short").when(slack < TIGHT, "tight").otherwise("ok")


def due(suspended: Column, due_at: Column, end: Column) -> Column:
    """A card without a date is due."""
    return ~F.coalesce(suspended, F.lit(False)) & (due_at.isNull() | (due_at < end))


def queue(cards: DataFrame, key: str, end: Column, room: int) -> DataFrame:
    """cards (key, id, created, due_at, reviewed_at, reps, suspended) with ``place``: what is due by date, then the first new ones."""
    new = F.col("reviewed_at").isNull() & (F.coalesce("reps", F.lit(0)) == 0)
    c = cards.withColumn("_new", new & ~F.coalesce("suspended", F.lit(False))).withColumn("_due", due(F.col("suspended"), F.col("due_at"), end) & ~new)
    c = c.where("_new OR _due")
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_new").orderBy(F.when(~F.col("_new"), F.col("due_at")), "created", "id"))).where((~F.col("_new")) | (F.col("_n") <= room))
    w = Window.partitionBy(key).orderBy("_new", "_n")
    return c.withColumn("place", F.row_number().over(w)).drop("_new", "_due", "_n")


def session_order(questions: DataFrame, key: str, seed: int) -> DataFrame:
    """questions (key, id, last) with ``place``: untried, then wrong, then the rest; at random, but repeatable, in each."""
    tier = F.when(F.col("last").isNull(), 0).when(~F.col("last"), 1).otherwise(2)
    return questions.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(tier, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id")))


def mulberry32(seed: str) -> Column:
    """The first number in 0..1 of the 32-bit generator with each seed. Products of 32-bit numbers are made of two of 48 bits,
    so nothing overflows."""
    mask = F.lit(0xFFFFFFFF)
    low = lambda x: x.bitwiseAND(mask)
    right = lambda x, n: F.shiftrightunsigned(x, n)

    def times(x: Column, y: Column) -> Column:
        return low(x.bitwiseAND(F.lit(0xFFFF)) * y + F.shiftleft((right(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16))

    def last(t: Column) -> Column:
        return low(t.bitwiseXOR(right(t, 14))) / F.lit(4294967296.0)

    def middle(t: Column) -> Column:
        return let(low(t.bitwiseXOR(low(t + times(t.bitwiseXOR(right(t, 7)), t.bitwiseOR(F.lit(61)))))), last)

    return let(low(F.col(seed).cast("long") + F.lit(0x6D2B79F5)), lambda a: let(times(a.bitwiseXOR(right(a, 15)), a.bitwiseOR(F.lit(1))), middle))


def probes(n: Column, most: int = 12) -> Column:
    """Page numbers at the middles of equal strata between a tenth and nine tenths; all pages of a short document."""
    k = F.lit(float(most))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.greatest(F.lit(1), F.least(n, F.floor(n * 0.1 + (n * 0.9 - n * 0.1) * (i + 0.5) / k + 0.5).cast("int"))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array_distinct(at))


def mad(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median, mad: the median and the median distance from it."""
    m = df.groupBy(key).agg(F.median(value).alias("median"))
    return df.join(m, key).groupBy(key).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def mode(df: DataFrame, key: str, value: Column) -> DataFrame:
    """key, mode: the most frequent value, the least of several."""
    n = df.groupBy(key, value.alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("x")).select(key, F.col("x.v").alias("mode"))


def valid_edges(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """edges (graph, a, b) between nodes (graph, id) that are there, no loops, each pair once, among the ``most`` nodes of
    a graph with most edges."""
    e = edges.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        e = e.join(nodes.select("graph", F.col("id").alias(side)), ["graph", side], "left_semi")
    degree = e.select("graph", F.explode(F.array("a", "b")).alias("id")).groupBy("graph", "id").agg(F.count("*").alias("n"))
    top = degree.withColumn("r", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("n"), "id"))).where(F.col("r") <= most)
    for side in ("a", "b"):
        e = e.join(top.select("graph", F.col("id").alias(side)), ["graph", side], "left_semi")
    return e.select("graph", "a", "b")
