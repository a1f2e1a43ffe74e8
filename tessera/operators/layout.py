"""Pages of positioned text: lines out of items, columns, reading order, roles, tables. All over rows and windows; y grows
downwards, and (doc, page) names a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import repeat_key

PAGE = ["doc", "page"]
#: Bins of a page's width; share of the busiest bin that counts as covered; bins that a column has at least; most columns.
BINS, COVERED, NARROW, COLUMNS = 100, 0.15, 15, 3
#: In font sizes: how far baselines of one line may differ, a gap that is a blank, a gap that parts cells, a raised item's size.
SAME_LINE, BLANK, CELL, RAISED = 0.3, 0.15, 1.0, 0.8
#: In parts of the page's height or the body's size: head and foot zones, sizes of body text, a heading's size.
ZONE, BODY_LEAST, BODY_MOST, HEADING = 0.08, 0.8, 1.3, 1.15


def clean_items(items: DataFrame) -> DataFrame:
    """Items (doc, page, item, text, x, y, w, size) without blank ones, rotated ones or those without a size; a width that
    cannot be is put at half a size for each character."""
    guess = F.length("text") * F.col("size") * 0.5
    ok = (F.trim("text") != "") & (F.col("size") > 0) & ~F.coalesce(F.col("rotated"), F.lit(False)) if "rotated" in items.columns else (F.trim("text") != "") & (F.col("size") > 0)
    return items.where(ok).withColumn("w", F.when((F.col("w") > 0) & (F.col("w") <= 4 * guess), F.col("w")).otherwise(guess))


def join_kind(dy: Column, size: Column, other: Column) -> Column:
    """same, raised or null: does an item (size) belong to a line (other) that lies dy away?"""
    return F.when(F.abs(dy) <= SAME_LINE * F.greatest(size, other), F.when(size < RAISED * other, "raised").otherwise("same"))


def lines_of(items: DataFrame) -> DataFrame:
    """items with ``line``: on a page, from top to bottom, an item that lies further than a part of its size below the one
    before begins a line."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "item")
    step = F.col("y") - F.lag("y").over(w)
    new = F.when(step > SAME_LINE * F.greatest("size", F.lag("size").over(w)), 1).otherwise(0)
    return items.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def line_texts(items: DataFrame) -> DataFrame:
    """doc, page, line, text, cells, x, y, w, size: a line's items from left to right with blanks where there is a gap; an item
    printed twice on one place counts once; wide gaps part cells."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "item")
    before = F.lag(F.struct("text", "x", "w")).over(w)
    i = items.withColumn("_b", before).where(F.col("_b").isNull() | ~((F.col("_b.text") == F.col("text")) & (F.abs(F.col("x") - F.col("_b.x")) < 0.2 * F.col("size"))))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    i = i.withColumn("_gap", gap).withColumn("_t", F.concat(F.when(F.col("_gap") > BLANK * F.col("size"), " ").otherwise(""), F.trim("text")))
    g = i.groupBy(*PAGE, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item", "_t"))), lambda r: r["_t"]), "").alias("text"),
        (F.count_if(F.col("_gap") > CELL * F.col("size")) + 1).alias("cells"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.max("size").alias("size"),
    )
    return g


def with_boxes(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """lines with left, top, right, bottom: what a line covers, cut off at the page's edges."""
    cut = lambda c, most: F.greatest(F.lit(0.0), F.least(c, most))
    return lines.select("*", cut(F.col("x"), width).alias("left"), cut(F.col("y") - F.col("size"), height).alias("top"), cut(F.col("x") + F.col("w"), width).alias("right"), cut(F.col("y") + 0.25 * F.col("size"), height).alias("bottom"))


def boxes(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """doc, page, line, left, top, right, bottom: what a line covers, cut off at the page's edges."""
    return with_boxes(lines, width, height).select(*PAGE, "line", "left", "top", "right", "bottom")


def page_metrics(lines: DataFrame) -> DataFrame:
    """doc, page, size, leading: the median font size, and the median step from line to line in a column."""
    w = Window.partitionBy(*PAGE, "col").orderBy("y", "line")
    step = F.col("y") - F.lag("y").over(w)
    return lines.withColumn("_s", F.when(step > 0, step)).groupBy(*PAGE).agg(F.median("size").alias("size"), F.median("_s").alias("leading"))


def column_metrics(lines: DataFrame) -> DataFrame:
    """doc, page, col, left, width: the most frequent left edge (whole units), the least of several, and the widest line."""
    n = lines.groupBy(*PAGE, "col", F.floor(F.col("x") + 0.5).cast("long").alias("left")).agg(F.count("*").alias("n"), F.max("w").alias("width"))
    return n.groupBy(*PAGE, "col").agg(F.min_by("left", F.struct(-F.col("n"), "left")).alias("left"), F.max("width").alias("width"))


def body_lines(lines: DataFrame, metrics: DataFrame, height: Column) -> DataFrame:
    """Lines of about the page's font size, not in the head or foot zone."""
    j = lines.join(metrics.select(*PAGE, F.col("size").alias("_m")), PAGE)
    return j.where(F.col("y").between(ZONE * height, (1 - ZONE) * height) & F.col("size").between(BODY_LEAST * F.col("_m"), BODY_MOST * F.col("_m"))).drop("_m")


def tracks(lines: DataFrame, width: Column) -> DataFrame:
    """doc, page, track, lo, hi (bins): stretches of the page's width that lines cover, wide enough for a column. A line adds
    one where its first bin is and takes one off behind its last; running sums of these say how many lines cover the bins
    from there on, and a bin counts if enough lines do."""
    first = F.greatest(F.lit(0), F.floor(F.col("x") * BINS / width)).cast("int")
    last = F.least(F.lit(BINS - 1), F.floor((F.col("x") + F.col("w")) * BINS / width)).cast("int")
    ends = lines.select(*PAGE, first.alias("a"), last.alias("b")).where("a <= b").select(*PAGE, F.inline(F.array(F.struct(F.col("a").alias("lo"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("lo"), F.lit(-1).alias("d")))))
    w = Window.partitionBy(*PAGE).orderBy("lo")
    n = ends.groupBy(*PAGE, "lo").agg(F.sum("d").alias("d")).withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.lead("lo").over(w) - 1)
    n = n.withColumn("_top", F.max("n").over(Window.partitionBy(*PAGE))).where((F.col("n") > 0) & (F.col("n") >= COVERED * F.col("_top")))
    new = F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1)
    run = n.withColumn("_new", new).withColumn("_r", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = run.groupBy(*PAGE, "_r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") + 1 >= NARROW)
    return t.withColumn("track", F.row_number().over(Window.partitionBy(*PAGE).orderBy("lo")).cast("int")).drop("_r")


def columns(lines: DataFrame, width: Column) -> DataFrame:
    """doc, page, columns: how many columns a page has, three at most; one that cannot be told is one."""
    pages = lines.select(*PAGE).distinct()
    n = tracks(lines, width).groupBy(*PAGE).agg(F.least(F.lit(COLUMNS), F.count("*")).cast("int").alias("columns"))
    return pages.join(n, PAGE, "left").select(*PAGE, F.coalesce("columns", F.lit(1)).alias("columns"))


def with_columns(lines: DataFrame, width: Column) -> DataFrame:
    """lines with ``col``: the track that holds a line's middle, 0 for a line that spans tracks or lies in none."""
    edges = F.struct("track", (F.col("lo") * width / BINS).alias("a"), ((F.col("hi") + 1) * width / BINS).alias("b"))
    t = tracks(lines, width).groupBy(*PAGE).agg(F.collect_list(edges).alias("_tracks"))  # BINS / NARROW of them at most
    held = F.filter("_tracks", lambda t: (F.col("x") >= t["a"] - 1e-9) & (F.col("x") + F.col("w") <= t["b"] + 1e-9))
    col = F.coalesce(F.array_max(F.transform(held, lambda t: t["track"])), F.lit(0))
    return lines.join(t, PAGE, "left").select(*lines.columns, col.alias("col"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines (col 0: spanning) with ``place``: a spanning line cuts the page into bands; in a band column by column."""
    w = Window.partitionBy(*PAGE).orderBy("y", "line")
    span = (F.col("col") == 0).cast("int")
    band = F.sum(span).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 2 - span
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_band", "col", "y", "x", "line"))
    return lines.withColumn("_band", band).withColumn("place", place).drop("_band")


def top_band(lines: DataFrame) -> DataFrame:
    """The lines of a page's uppermost row, if a gap of more than the usual leading parts it from the rest."""
    m = page_metrics(lines.withColumn("col", F.lit(1))).select(*PAGE, "leading")
    w = Window.partitionBy(*PAGE)
    top = lines.withColumn("_t", F.min("y").over(w)).join(m, PAGE)
    top = top.withColumn("_head", F.col("y") <= F.col("_t") + SAME_LINE * F.col("size")).withColumn("_next", F.min(F.when(~F.col("_head"), F.col("y"))).over(w))
    return top.where(F.col("_head") & (F.col("_next") - F.col("y") > 1.5 * F.col("leading"))).drop("_t", "_head", "_next", "leading")


def folios(lines: DataFrame) -> DataFrame:
    """doc, page, line of page numbers: lines that end in a number whose distance to the page's place is that of a neighbouring
    page's."""
    n = F.regexp_extract("text", r"(\d{1,4})\s*$", 1).try_cast("int")
    c = lines.withColumn("_n", n).where("_n IS NOT NULL").select(*PAGE, "line", (F.col("_n") - F.col("page")).alias("off"))
    other = c.select("doc", "off", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    return c.join(other, ["doc", "off", "page"], "left_semi").select(*PAGE, "line")


def roles(lines: DataFrame, height: Column) -> DataFrame:
    """lines with ``role``: folio, runner (a line of the head or foot zone that a neighbouring page repeats but for its numbers),
    heading (large, and not followed by text of its size), or body."""
    zone = (F.col("y") < ZONE * height) | (F.col("y") > (1 - ZONE) * height)
    k = lines.withColumn("_zone", zone).withColumn("_k", repeat_key(F.col("text")))
    there = k.where("_zone").select("doc", "_k", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct().withColumn("_again", F.lit(True))
    f = folios(k.where("_zone")).withColumn("_folio", F.lit(True))
    m = lines.groupBy(*PAGE).agg(F.median("size").alias("_m"))
    w = Window.partitionBy(*PAGE).orderBy("y", "line")
    j = k.withColumn("_after", F.lead("size").over(w)).join(there, ["doc", "_k", "page"], "left").join(f, [*PAGE, "line"], "left").join(m, PAGE)
    large = (F.col("size") >= HEADING * F.col("_m")) & (F.coalesce("_after", F.lit(0.0)) < F.col("size"))
    role = F.when(F.col("_folio"), "folio").when(F.col("_zone") & F.col("_again"), "runner").when(large, "heading").otherwise("body")
    return j.withColumn("role", role).select(*lines.columns, "role")


def tables(lines: DataFrame, least: int = 3) -> DataFrame:
    """doc, page, table, first, last, rows, verdict: runs of lines of several cells. A run is a table if it is long enough and
    most of its lines have as many cells as its first."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    multi = F.col("cells") > 1
    i = lines.withColumn("_run", F.sum((~multi).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(multi)
    i = i.withColumn("_first", F.first("cells").over(Window.partitionBy(*PAGE, "_run").orderBy("line")))
    g = i.groupBy(*PAGE, "_run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("rows"), F.count_if(F.col("cells") == F.col("_first")).alias("_same"))
    verdict = F.when(F.col("rows") < least, "short").when(F.col("_same") * 2 <= F.col("rows"), "ragged").otherwise("table")
    return g.withColumn("table", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first")).cast("int")).withColumn("verdict", verdict).drop("_run", "_same")


def label_rows(lines: DataFrame) -> DataFrame:
    """doc, page, label, line: text beside labels, as rows: each line of a later column belongs to the last line of the first
    column at or above it."""
    w = Window.partitionBy(*PAGE).orderBy("y", "col", "line").rowsBetween(Window.unboundedPreceding, 0)
    label = F.last(F.when(F.col("col") == 1, F.col("line")), True).over(w)
    return lines.where("col > 0").withColumn("label", label).where((F.col("col") > 1) & F.col("label").isNotNull()).select(*PAGE, "label", "line")


def flow(lines: DataFrame) -> DataFrame:
    """The lines that a page's text flows through: bodies and headings."""
    return lines.where(F.col("role").isin("body", "heading"))


def absorbed(lines: DataFrame) -> DataFrame:
    """lines with ``into``: the line that a small one (a note's number, an index) belongs to: the next if it is larger and begins
    less than its size below, else the one before on the same terms; null for a line of its own."""
    w = Window.partitionBy(*PAGE, "col").orderBy("y", "line")
    near = lambda other, dy: F.when((F.col("size") < RAISED * other["size"]) & (dy < 0.8 * other["size"]), other["line"])
    here = F.struct("line", "y", "size")
    after, before = F.lead(here).over(w), F.lag(here).over(w)
    j = lines.withColumn("_a", after).withColumn("_b", before)
    return j.withColumn("into", F.coalesce(near(F.col("_a"), F.col("_a.y") - F.col("y")), near(F.col("_b"), F.col("y") - F.col("_b.y")))).drop("_a", "_b")


def described(lines: DataFrame, gap: float = 1.5) -> DataFrame:
    """doc, page, para, kind, lines, chars: a page as paragraphs, in reading order (place): a line of another role, or further
    below than ``gap`` sizes, begins one. Kinds: heading, body, and aside for what does not flow (runners, folios)."""
    kind = F.when(F.col("role").isin("heading", "body"), F.col("role")).otherwise("aside")
    w = Window.partitionBy(*PAGE).orderBy("place")
    d = lines.withColumn("kind", kind)
    step = F.col("y") - F.lag("y").over(w)
    new = F.when((F.col("kind") == F.lag("kind").over(w)) & step.between(0, gap * F.col("size")), 0).otherwise(1)
    d = d.withColumn("_new", new).withColumn("para", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*PAGE, "para").agg(F.first("kind").alias("kind"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))
