"""Sections of books in two passes: where they are, out of windows of pages read apart, then what is in them.

In the first pass a heading holds to the end of its window of WINDOW pages; what stands in a window before its first heading
has no section there. Of each section its pages are kept, and how many questions and answers it has. The second pass takes
the MOST heaviest sections of a book, widens them by PAD pages and reads each as one piece, so a question meets its answer
however many windows lie between. A piece is not put together: each paragraph is read once, keeps the last heading before it
with its page, and belongs to the one piece of its section's name if it and that heading are in it. No task needs more than
a page of a book, or one row a page of a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.questions import answer_list, question_label

WINDOW, MOST, PAD = 32, 200, 1
HEADING = r"^\s*(?i:section)\s+([IVXLC]{1,5})\b"


def _read(paras: DataFrame) -> DataFrame:
    """doc, page, seq, heading (page, name) and items (section, number, answer or not) of the paragraphs that have any, each
    read once. A heading names a section; a label may name one; other items stand in that of the last heading before them."""
    t = F.col("text")
    heading = F.nullif(F.upper(F.regexp_extract(t, HEADING, 1)), F.lit(""))
    q = question_label(t)
    item = lambda x, answer: F.struct(x["section"].alias("section"), x["number"].alias("number"), F.lit(answer).alias("answer"))
    items = F.coalesce(F.transform(answer_list(t), lambda x: item(x, True)), F.when(q.isNotNull(), F.array(item(q, False))))
    p = paras.where(t.rlike(HEADING) | t.rlike(r"\.\s")).select("doc", "page", "seq", heading.alias("_own"), items.alias("_items"))
    return p.select("doc", "page", "seq", F.when(F.col("_own").isNotNull(), F.struct("page", F.col("_own").alias("name"))).alias("_own"), "_items")


def items(paras: DataFrame) -> DataFrame:
    """doc, page, named (the section of its label), number, answer (is it one), heading (page and name of the last heading
    before it in its book, or null). Places (seq) rise with the pages, so a page's rows are read alone, and what earlier
    pages leave open comes to it as one row a page."""
    rows = _read(paras)
    w = Window.partitionBy("doc", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("_own IS NOT NULL").groupBy("doc", "page").agg(F.max_by("_own", "seq").alias("_last"))
    each = rows.select("doc", "page").distinct().join(last, ["doc", "page"], "left")
    before = F.last("_last", True).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    carried = each.select("doc", "page", before.alias("_before"))
    r = rows.withColumn("_here", F.last("_own", True).over(w)).where("_items IS NOT NULL").join(carried, ["doc", "page"])
    return r.select("doc", "page", F.coalesce("_here", "_before").alias("heading"), F.explode("_items").alias("_x")).select("doc", "page", "heading", F.col("_x.section").alias("named"), "_x.number", "_x.answer")


def _spans(found: DataFrame) -> DataFrame:
    window = lambda page: F.floor((page - 1) / WINDOW)
    near = F.when(window(F.col("heading.page")) == window(F.col("page")), F.col("heading.name"))
    part = found.withColumn("section", F.coalesce("named", near)).where("section IS NOT NULL")
    return part.groupBy("doc", "section").agg(F.min("page").alias("start"), F.max("page").alias("end"), F.count("*").alias("weight"))


def spans(paras: DataFrame) -> DataFrame:
    """doc, section, start, end, weight of paras (doc, page, seq, text): a heading holds to the end of its window of pages."""
    return _spans(items(paras))


def kept(found: DataFrame, most: int = MOST) -> DataFrame:
    """The heaviest sections of each book; ties to the one that begins first, then by name."""
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), "start", "section")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def index(paras: DataFrame, most: int = MOST) -> DataFrame:
    """doc, section, start, end, questions, answered: sections of paras (doc, page, seq, text) as above. A question number
    counts once in a section, the first time; it is answered if any answer of its section has its number."""
    last = paras.groupBy("doc").agg(F.max("page").alias("_last"))
    found = items(paras)
    want = kept(_spans(found), most).join(last, "doc").select("doc", F.col("section").alias("own"), "start", "end", F.greatest(F.lit(1), F.col("start") - PAD).alias("_lo"), F.least("_last", F.col("end") + PAD).alias("_hi"))
    # read as one piece, an item belongs to the section that it or the last heading before it names; one piece has that name
    once = found.groupBy("doc", "page", "named", "number", F.col("heading.page").alias("_from"), F.col("heading.name").alias("_head")).agg(F.max(~F.col("answer")).alias("asked"), F.max("answer").alias("answered"))
    inside = F.col("page").between(F.col("_lo"), F.col("_hi")) & (F.col("named").isNotNull() | (F.col("_from") >= F.col("_lo")))
    own = once.withColumn("own", F.coalesce("named", "_head")).where("own IS NOT NULL").join(want.select("doc", "own", "_lo", "_hi"), ["doc", "own"]).where(inside)
    numbers = own.groupBy("doc", "own", "number").agg(F.max("asked").alias("asked"), F.max("answered").alias("answered"))
    counts = numbers.groupBy("doc", "own").agg(F.count_if("asked").alias("questions"), F.count_if(F.col("asked") & F.col("answered")).alias("answered"))
    return want.join(counts, ["doc", "own"], "left").select("doc", F.col("own").alias("section"), "start", "end", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("answered", F.lit(0)).alias("answered"))
