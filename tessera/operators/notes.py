"""Notes on texts: pieces of a selection, rows and books of notes, notes whose document is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import ranges

#: Characters of one quote; kinds and numbers by which a paragraph can be summarised.
QUOTE = 400
KINDS, SENTENCES, CHARS = ("body", "list"), 2, 60


def placed(paras: DataFrame, key: str, text: str = "text", order: str = "seq") -> DataFrame:
    """paras with ``base``: where each begins in its page's text, one line break after each."""
    n = F.length(text) + 1
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return paras.withColumn("base", F.coalesce(F.sum(n).over(w), F.lit(0)))


def pieces(selections: DataFrame, paras: DataFrame, key: str, most: int = QUOTE) -> DataFrame:
    """selection, seq, piece, lo, hi: a selection (key, selection, lo, hi; either may come first) in pieces of ``most``
    characters at most, none over a paragraph's end. paras: key, seq, base, text."""
    s = selections.select(key, "selection", F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b"))
    j = s.join(paras.select(key, "seq", F.col("base").alias("p"), (F.col("base") + F.length("text")).alias("q")), key).where("a < q AND b > p")
    j = j.select("selection", "seq", F.greatest("a", "p").alias("s"), F.least("b", "q").alias("e")).where("s < e")
    cut = j.select("selection", "seq", "e", F.explode(F.sequence("s", F.col("e") - 1, F.lit(most))).alias("lo"))
    w = Window.partitionBy("selection").orderBy("seq", "lo")
    return cut.select("selection", "seq", F.row_number().over(w).alias("piece"), "lo", F.least("e", F.col("lo") + most).alias("hi"))


def note_records(cut: DataFrame, note: Column) -> DataFrame:
    """Records of the pieces: one group for a selection, named by its first piece, which alone holds the note."""
    name = lambda n: F.concat_ws(":", F.col("selection").cast("string"), n.cast("string"))
    return cut.select(name(F.col("piece")).alias("id"), name(F.lit(1)).alias("group"), "selection", "piece", "lo", "hi", F.when(F.col("piece") == 1, note).otherwise("").alias("note"))


def rows_of(records: DataFrame) -> DataFrame:
    """doc, group, id, page, note, quote, pieces out of records (doc, group, id, page, pos, note, quote): one row a group. Its
    leader is the record that the group is named by, else the first; its note the leader's, else the first that is not blank;
    its quote all quotes in order. A group is what one selection was cut into."""
    blank = F.trim(F.coalesce("note", F.lit(""))) == ""
    lead = F.struct((F.col("id") != F.col("group")).alias("other"), "pos", "id", "page", "note")
    g = records.groupBy("doc", "group").agg(
        F.min_by(F.struct("id", "page", "note"), lead).alias("lead"),
        F.min_by("note", F.when(~blank, F.struct("pos", "id", "note"))).alias("some"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "quote"))), lambda x: x["quote"]), " ").alias("quote"),
        F.count("*").alias("pieces"),
    )
    own = F.trim(F.coalesce("lead.note", F.lit(""))) != ""
    return g.select("doc", "group", F.col("lead.id").alias("id"), F.col("lead.page").alias("page"), F.when(own, F.col("lead.note")).otherwise(F.coalesce("some", F.lit(""))).alias("note"), "quote", "pieces")


def filtered(rows: DataFrame, colors: list[str] | None = None, noted: bool = False, lost: DataFrame | None = None, live: DataFrame | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """Rows of some colours, with a note, in a range of pages, or lost: of a group named in lost (doc, group) or of a document
    that is not in live (doc). What is not given does not filter."""
    if colors:
        rows = rows.where(F.col("color").isin(*colors))
    if noted:
        rows = rows.where(F.trim(F.coalesce("note", F.lit(""))) != "")
    if pages:
        rows = rows.where(F.col("page").between(*pages))
    if lost is not None and live is not None:
        gone = rows.join(live.select("doc").distinct(), "doc", "left_anti")
        here = rows.join(live.select("doc").distinct(), "doc", "left_semi").join(lost.select("doc", "group").distinct(), ["doc", "group"], "left_semi")
        rows = gone.select(rows.columns).unionByName(here.select(rows.columns))
    return rows


def books(rows: DataFrame, docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """rows with title, gone, chapter and place: books that are here by title, then those that are gone; in a book by chapter,
    and before the first one by page. docs: doc, title; chapters: doc, start."""
    at = ranges.chapter_of(rows.select("doc", "page").distinct(), chapters, "doc", "page", "start")
    j = rows.join(at.select("doc", "page", "chapter", F.col("lo").alias("head")), ["doc", "page"], "left").join(docs.select("doc", "title", F.lit(False).alias("here")), "doc", "left")
    j = j.withColumn("gone", F.col("here").isNull()).withColumn("head", F.when(F.col("chapter") >= 0, F.col("head")).otherwise(F.col("page")))
    w = Window.partitionBy("doc").orderBy("head", F.col("chapter") < 0, "page", "group")
    return j.withColumn("place", F.row_number().over(w)).drop("here")


def reattach(records: DataFrame, live: DataFrame, file_hash: str, new_id: str) -> DataFrame:
    """records with the new document for those of this file hash whose own is not among the live ones (doc)."""
    dead = records.select("doc").distinct().join(live.select("doc").distinct(), "doc", "left_anti").withColumn("_dead", F.lit(True))
    j = records.join(dead, "doc", "left")
    move = (F.col("file_hash") == file_hash) & F.coalesce("_dead", F.lit(False))
    return j.withColumn("doc", F.when(move, F.lit(new_id)).otherwise(F.col("doc"))).drop("_dead").select(records.columns)


def reading_order(page: Column, para: Column, created: Column, outline: Column) -> list[Column]:
    """Page, the paragraph's number in it (an outline first, none last), then time."""
    n = F.regexp_extract(F.coalesce(para, F.lit("")), r":p(\d+)$", 1).try_cast("int")
    return [page, F.coalesce(n, F.when(outline, -1).otherwise(2**31 - 1)), created]


def relocate(records: DataFrame, paras: DataFrame, key: str) -> DataFrame:
    """records (key, id, hash, para) with ``now``: the paragraph (key, para, hash) that has their text; of several, the one
    with the same id, then the first; null if there is none."""
    p = paras.select(key, "hash", F.col("para").alias("_p"))
    j = records.join(p, [key, "hash"], "left")
    pick = F.struct((~F.col("_p").eqNullSafe(F.col("para"))).alias("other"), "_p")
    return j.groupBy(key, "id").agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), pick)).alias("now"))


def eligible(kind: Column, sentences: Column, chars: Column) -> Column:
    """Can a paragraph be summarised?"""
    return F.coalesce(kind, F.lit("body")).isin(*KINDS) & (sentences >= SENTENCES) & (chars >= CHARS)


def quizzable(kind: Column, chars: Column, text: Column) -> Column:
    """Can a paragraph be asked about? Not if it holds a reference's identifier."""
    return F.coalesce(kind, F.lit("body")).isin(*KINDS) & (chars >= CHARS) & ~text.rlike(r"(?i)\bpmc?id\b|\bdoi\b")


def summary_target(units: DataFrame, key: str) -> DataFrame:
    """units (key, at, para, seg or null) with ``target``: the paragraph that a reader at each unit has read last. At the first
    sentence of a paragraph that is the one before; at no sentence (seg null), the nearest sentence's before."""
    w = Window.partitionBy(key).orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("seg").isNotNull()
    run = units.withColumn("_new", real & ~F.col("seg").eqNullSafe(F.last(F.when(real, F.col("seg")), True).over(before)))
    run = run.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.where(real).groupBy(key, "_run").agg(F.max_by("para", "at").alias("_p"))
    heads = ends.select(F.col(key).alias("_k"), F.col("_run").alias("_r"), F.lag("_p").over(Window.partitionBy(key).orderBy("_run")).alias("_before"))
    j = run.join(heads, (F.col(key) == F.col("_k")) & (F.col("_run") == F.col("_r")), "left").drop("_k")
    nearest = F.last(F.when(real, F.col("para")), True).over(before)
    return j.withColumn("target", F.when(~real, nearest).when(F.col("_before").isNotNull() & (F.col("_before") != F.col("para")), F.col("_before")).otherwise(F.col("para"))).drop("_new", "_run", "_r", "_before")


def cards_of(cards: DataFrame, live: DataFrame, doc: str, file: str, name_of) -> DataFrame:
    """Cards (doc, id, front, name) of one document, and those of documents that are gone (not in live) whose name is what
    name_of(file, front) makes of this document's file."""
    here = cards.where(F.col("doc") == doc)
    gone = cards.where(F.col("name") == name_of(F.lit(file), F.col("front"))).join(live.select("doc").distinct(), "doc", "left_anti")
    return here.select("doc", "id").unionByName(gone.select("doc", "id"))
