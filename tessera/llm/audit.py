"""How filters interact: what each of five removes in every order, what it alone removes, and its Shapley value.

Whether a text repeats another is found by partition refinement: rows are split by their length in code points, then by
the hashes of successive blocks of text (BLOCKS), and a class of one row drops out each time; only names of classes and
ids take part. The full texts of the classes that are left are then compared, grouped where they lie before they are
shuffled, and rows whose id is not the least of their text are marked. All filters together make a mask of five bits a
row, and orders are worked out on the counts of masks.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved

FILTERS = "ABCDE"
#: Code points at which the blocks of a text end; the last block goes to its end.
BLOCKS = (64, 1024, 16384)
#: Classes of which all tasks are sent the names (8 bytes each) to leave other texts out; beyond, all texts are grouped.
MOST_SENT = 1 << 21

_WORD = r"[^\x20\x09-\x0D]+"


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def conditions(text: Column) -> list[Column]:
    """Of filters A to D, true where a text fails: under 200 words; 100 x distinct words < 50 x words; 100 x capitals A-Z >
    3 x code points; one of #$%&*| in it."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return [F.size(words) < 200, F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3, text.rlike(r"[#$%&*|]")]


def classes(text: Column) -> list[Column]:
    """Names of a text's class after each split: its length, then each block's hash with the name before."""
    names = [F.length(text).cast("long")]
    for a, b in zip((0, *BLOCKS), (*BLOCKS, None)):
        block = F.substring(text, a + 1, b - a) if b else F.substring(text, a + 1, 2**31 - 1 - a)
        names.append(F.xxhash64(names[-1], _hash(block)))
    return names


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _facts(text: Column) -> list[Column]:
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(text))), F.lit(0))
    return [mask.alias("mask"), *(c.alias(f"c{i}") for i, c in enumerate(classes(text)))]


def repeats(texts: DataFrame, rows: DataFrame) -> tuple[Saved, bool]:
    """(class, least, texts) of the classes in which a text repeats, by refinement of ``rows`` (doc_id, c0, c1, ...) and then
    by the full texts of ``texts``; and whether some class holds more than one text."""
    last = len(BLOCKS) + 1
    at, kept = rows, None
    for i in range(last + 1):
        again = Saved(at.groupBy(f"c{i}").agg(F.count("*").alias("rows")).where("rows > 1").select(f"c{i}"))
        at = at.join(again.df, f"c{i}", "left_semi").select("doc_id", *(f"c{j}" for j in range(i + 1, last + 1)))
        if 0 < i < last:  # the length alone parts few rows
            now = Saved(at)
            at = now.df
            if kept:
                kept.drop()
            kept = now
    own = texts.select(classes(F.col("text"))[-1].alias("class"), "text", "doc_id")
    left = again.df.withColumnRenamed(f"c{last}", "class")
    if left.count() <= MOST_SENT:
        own = own.join(F.broadcast(left), "class", "left_semi")  # checked: 8 bytes for each of MOST_SENT
    same = own.groupBy("class", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    out = Saved(same.groupBy("class").agg(F.min("least").alias("least"), F.count("*").alias("texts"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows"))
    return out, not out.df.where("texts > 1").isEmpty()


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): bit i of mask is set if the document fails filter i of FILTERS. E, the last, fails a text that is
    also that of a smaller doc_id. Null texts are empty; a row without id is smaller than none and larger than none; rows
    that share id and text are not smaller than each other."""
    texts = _texts(docs)
    names = [f"c{i}" for i in range(len(BLOCKS) + 2)]
    facts = Saved(texts.select("doc_id", "part", *_facts(F.col("text"))))
    found, mixed = repeats(texts, facts.df.select("doc_id", *names))
    rows = facts.df.select("doc_id", "part", "mask", F.col(names[-1]).alias("class"))
    fails = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    out = rows.join(found.df, "class", "left").where("texts IS NULL OR texts = 1").select("doc_id", "part", (F.col("mask") + fails).alias("mask"))
    if mixed:  # different texts of one name: of these classes texts are what rows meet by
        own = texts.select("*", *_facts(F.col("text"))).withColumnRenamed(names[-1], "class").join(found.df.where("texts > 1").select("class"), "class", "left_semi")
        least = own.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
        out = out.unionByName(own.join(least, ["class", "text"]).select("doc_id", "part", (F.col("mask") + fails).alias("mask")))
    return out


def interactions(rows: DataFrame) -> DataFrame:
    """Of counts (part, mask, n, good, toxic): a row for each part, order of the filters and step."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = rows.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.select("*", own.alias("own"), before.alias("before"))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda c, what="n": F.sum(F.when(c, F.col(what)).otherwise(0)).cast("long")
    first = factorial(len(FILTERS))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        # of all orders, each filter that a document fails comes first of these in an equal number
        F.sum(F.when(fails, F.col("n") * F.expr(f"{first} div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: the five filters over
    ``docs`` (doc_id, text, lang) in all orders, by language (null: the empty string), with ``labels`` (doc_id, quality, toxic).

    A document with several rows of labels has a label if one of them says so; a row without id has none. Rows that share an
    id each count. Very long texts are worked on like any other, their words as one array. Other columns take no part. No
    documents: no rows.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = Saved(marked.where("doc_id IS NOT NULL AND good + toxic > 0"))
    rows = masked(docs).join(marked.df, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return interactions(counts)
