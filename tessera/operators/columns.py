"""How many columns a page has, one to three, and where they part: by the gaps that its lines share.

Rows are runs of text (doc, page, line, run, x0, x1, chars) on pages (doc, page, width, font). The page's width is cut into
BINS; a bin is a valley if, of the lines that pass over its middle (spanning ones too), the SHARE has a gap there. Valleys
side by side make a band, and a band as wide as WIDE letters is a gutter. Two columns need starts of runs that stand in
line on both sides; three need two gutters apart, and three sides of justified prose of like length. Runs, pages and
gutters are stored once and dealt by page to tasks of some ROWS runs, where each step counts bins or runs of a page;
nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stored

PAGE = ["doc", "page"]
#: Runs that a task takes.
ROWS = 250_000
#: Bins; where gutters are sought; lines that must pass; the share of them that must part; letters of a gutter's width.
BINS, FROM, TO, PASSING, SHARE, WIDE = 100, 0.30, 0.70, 4, 0.55, 1.2
#: Starts on each side and how far they may deviate, in letters.
STARTS, DEVIATE = 4, 3.0
#: Three columns: gutters' distance (of the width), lines and mean characters of a side, share of full runs, what is full (of
#: the run at FULL_AT of all by width), the shortest side to the longest.
APART, LINES, PROSE, FULL, FULL_WIDTH, FULL_AT, BALANCE = 0.2, 12, 25, 0.5, 0.85, 0.9, 0.4


def body(lines: DataFrame, height: Column, edge: float = 0.08, low: float = 0.7, high: float = 1.4) -> DataFrame:
    """Lines (doc, page, baseline, size) that are neither at a page's edges nor far from its median size."""
    m = lines.groupBy(*PAGE).agg(F.median("size").alias("_m"))
    j = lines.join(m, PAGE)
    return j.where((F.col("baseline").between(height * edge, height * (1 - edge))) & F.col("size").between(F.col("_m") * low, F.col("_m") * high)).drop("_m")


def valleys(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, bin, passing, parted: of each bin where gutters are sought, how many lines pass its middle and have a gap there."""
    first, last = int(-(-FROM * BINS // 1)), int(TO * BINS)
    r = runs.join(pages.select(*PAGE, (F.col("width") / BINS).alias("_b")), PAGE)
    line = Window.partitionBy(*PAGE, "line").orderBy("run")
    gap = r.withColumn("_from", F.lag("x1").over(line)).where("x0 > _from")
    clip = lambda lo, hi: F.when(F.greatest(lo, F.lit(first)) <= F.least(hi, F.lit(last)), F.sequence(F.greatest(lo, F.lit(first)), F.least(hi, F.lit(last))))
    at = lambda x: F.col(x) / F.col("_b") - 0.5
    parted = gap.select(*PAGE, "line", F.explode(clip(F.ceil(at("_from")).cast("int"), (F.ceil(at("x0")) - 1).cast("int"))).alias("bin")).distinct()
    ends = r.groupBy(*PAGE, "line").agg(F.min_by("x0", "run").alias("x0"), F.max_by("x1", "run").alias("x1"), F.first("_b").alias("_b"))
    passing = ends.select(*PAGE, F.explode(clip((F.floor(at("x0")) + 1).cast("int"), (F.ceil(at("x1")) - 1).cast("int"))).alias("bin"))
    n = passing.groupBy(*PAGE, "bin").agg(F.count("*").alias("passing"))
    h = parted.groupBy(*PAGE, "bin").agg(F.count("*").alias("parted"))
    return n.join(h, [*PAGE, "bin"], "left").select(*PAGE, "bin", "passing", F.coalesce("parted", F.lit(0)).alias("parted"))


def gutters(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, rank, x, of: bands of valleys that are wide enough, the deepest first, with their middle and how many there are."""
    v = valleys(runs, pages).where((F.col("passing") >= PASSING) & (F.col("parted") >= F.col("passing") * SHARE))
    run = F.col("bin") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("bin"))
    b = v.withColumn("_run", run).groupBy(*PAGE, "_run").agg(F.min("bin").alias("a"), F.max("bin").alias("z"), F.sum("parted").alias("depth"))
    b = b.join(pages, PAGE).withColumn("_b", F.col("width") / BINS).where((F.col("z") - F.col("a") + 1) * F.col("_b") >= F.col("font") * WIDE)
    w = Window.partitionBy(*PAGE)
    x = (F.col("a") * F.col("_b") + (F.col("z") + 1) * F.col("_b")) / 2
    return b.select(*PAGE, F.row_number().over(w.orderBy(F.desc("depth"), "a")).alias("rank"), x.alias("x"), F.count("*").over(w).alias("of"))


def _sides(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, starts, deviation: how many runs begin on each side, and the median of how far from their median."""
    r = runs.select(*by, "x0", F.median("x0").over(Window.partitionBy(*by)).alias("_m"))
    return r.groupBy(*by).agg(F.count("*").alias("starts"), F.median(F.abs(F.col("x0") - F.col("_m"))).alias("deviation"))


def verdicts(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, columns, left, right, why: the columns of each page and their gutters (null where there is none); ``why`` says
    why a page with gutters does not have three columns: one (gutter), apart, lines, prose, ragged, balance or edges."""
    runs = stored(runs)
    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // ROWS))
    runs, pages = (x.repartition(tasks, *PAGE) for x in (runs, stored(pages)))
    g = stored(gutters(runs, pages)).repartition(tasks, *PAGE)
    limit = pages.select(*PAGE, (F.col("font") * DEVIATE).alias("_limit"), "width")
    best = g.where("rank = 1").select(*PAGE, F.col("x").alias("best"), "of")
    side = runs.join(best, PAGE).withColumn("side", F.when(F.col("x0") < F.col("best"), 0).when(F.col("x0") > F.col("best"), 1)).where("side IS NOT NULL")
    s = _sides(side, [*PAGE, "side"]).join(limit, PAGE)
    two = s.groupBy(*PAGE).agg((F.count_if((F.col("starts") >= STARTS) & (F.col("deviation") <= F.col("_limit"))) == 2).alias("two"))
    top = g.where("rank <= 2 AND of >= 2").groupBy(*PAGE).agg(F.min("x").alias("left"), F.max("x").alias("right"))
    r = runs.join(top, PAGE)
    mid = (F.col("x0") + F.col("x1")) / 2
    k = (mid >= F.col("left")).cast("int") + (mid >= F.col("right")).cast("int")
    begin = F.when(F.col("k") == 1, F.col("left")).when(F.col("k") == 2, F.col("right"))
    end = F.when(F.col("k") == 0, F.col("left")).when(F.col("k") == 1, F.col("right"))
    r = r.withColumn("k", k).where(~F.coalesce(F.col("x0") < begin, F.lit(False)) & ~F.coalesce(F.col("x1") > end, F.lit(False))).withColumn("_w", F.col("x1") - F.col("x0"))
    by = [*PAGE, "k"]
    w = Window.partitionBy(*by)
    r = r.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("_w")) - 1)
    r = r.withColumn("_ref", F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * FULL_AT)), F.col("_w"))).over(w))
    n_lines = r.select(*by, "line").distinct().groupBy(*by).agg(F.count("*").alias("lines"))
    seg = r.groupBy(*by).agg(F.avg("chars").alias("prose"), F.avg((F.col("_w") >= F.col("_ref") * FULL_WIDTH).cast("int")).alias("full"))
    seg = seg.join(n_lines, by).join(_sides(r, by), by).join(limit, PAGE)
    t = seg.groupBy(*PAGE).agg(
        F.count("*").alias("sides"), F.min("lines").alias("least"), F.max("lines").alias("most"), F.min("prose").alias("prose"), F.min("full").alias("full"),
        F.min(((F.col("starts") >= STARTS) & (F.col("deviation") <= F.col("_limit"))).cast("int")).alias("edges"),
    )
    j = best.join(two, PAGE, "left").join(top, PAGE, "left").join(t, PAGE, "left").join(limit.select(*PAGE, "width"), PAGE)
    why = (
        F.when(F.col("of") < 2, "one").when(F.col("right") - F.col("left") < F.col("width") * APART, "apart")
        .when((F.coalesce("sides", F.lit(0)) < 3) | (F.col("least") < LINES), "lines").when(F.col("prose") < PROSE, "prose").when(F.col("full") < FULL, "ragged")
        .when(F.col("least") < F.col("most") * BALANCE, "balance").when(F.col("edges") == 0, "edges")
    )
    j = j.withColumn("why", why)
    n = F.when(F.col("why").isNull(), 3).when(F.coalesce("two", F.lit(False)), 2).otherwise(1)
    j = j.withColumn("columns", n).select(*PAGE, "columns", F.when(n == 3, F.col("left")).when(n == 2, F.col("best")).alias("left"), F.when(n == 3, F.col("right")).alias("right"), "why")
    return pages.select(*PAGE).join(j, PAGE, "left").withColumn("columns", F.coalesce("columns", F.lit(1)))
