"""Word lists: views, exports, and a plan of what a file of rows changes in a stored list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.hashing import nfkc

#: Parts of speech that are known (fixed values); entries of one request; the header of a card deck.
POS = ("noun", "verb", "adj", "adv", "abbr", "phrase", "other")
BATCH = 20
DECK_HEADER = ("#separator:tab", "#html:false", "#columns:Front\tBack\tContext\tNote\tSource")
#: Fields of an entry that a file may change.
CONTENT = ("surface", "translation", "pos", "gloss", "context", "contextTr", "note")
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?(?:Z|[+-]\d{2}:?\d{2})$"


def one_line(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s+", " "))


def normal_pos(v: Column) -> Column:
    """A known part of speech, other, or nothing."""
    p = F.lower(one_line(v))
    return F.when(p == "", "").when(p.isin(*POS), p).otherwise("other")


def field_value(name: str, v: Column) -> Column:
    """A field as it is compared: notes keep their lines, the rest is one line."""
    if name == "note":
        return F.regexp_replace(F.regexp_replace(F.coalesce(v, F.lit("")), r"\r\n?", "\n"), r"^\s+|\s+$", "")
    return normal_pos(v) if name == "pos" else one_line(v)


def term_key(v: Column) -> Column:
    return F.lower(one_line(nfkc(v)))


def file_time(v: Column) -> Column:
    """Milliseconds out of what this engine writes into files: 13 digits, or a date and time with its zone; else null."""
    t = F.trim(v)
    return F.when(t.rlike(r"^\d{13}$"), t.try_cast("long")).when(t.rlike(_ISO), F.unix_millis(t.try_cast("timestamp")))


def ms_of(v: Column) -> Column:
    """Milliseconds out of digits or any date and time that can be read."""
    t = F.trim(v)
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).otherwise(F.unix_millis(t.try_cast("timestamp")))


def retry_after(v: Column, now: Column) -> Column:
    """Seconds to wait: a number, or the time until an HTTP date."""
    t = F.trim(v)
    at = F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.lit(0), F.floor((F.unix_millis(at) - F.unix_millis(now)) / 1000 + 0.5))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(at.isNotNull(), wait).cast("long")


def no_translation(kind: Column, translation: Column) -> Column:
    return (kind == "term") & (one_line(translation) == "")


def view(entries: DataFrame, query: str = "", sort: str = "added", doc: str | None = None) -> DataFrame:
    """Terms of one document or of all that hold the query in term, surface or translation; newest first, or by the alphabet."""
    rows = entries.where("kind = 'term'")
    if doc is not None:
        rows = rows.where(F.col("doc_id") == doc)
    if q := " ".join(query.lower().split()):
        rows = rows.where(F.exists(F.array("term", "surface", "translation"), lambda x: F.contains(F.lower(x), F.lit(q))))
    return rows.orderBy("term", "created") if sort == "alpha" else rows.orderBy(F.desc("created"), "term")


def fingerprint(entry: dict[str, Column], updated: Column) -> Column:
    """What an entry says, as a hash: an edit based on another state can be told."""
    return F.sha2(F.to_json(F.array(F.coalesce(updated, F.lit(0)).cast("string"), *[field_value(k, v) for k, v in entry.items()])), 256)


def deck(entries: DataFrame) -> DataFrame:
    """(at, value): lines of a tab-separated card deck, its header first."""
    cell = lambda c: one_line(F.col(c))
    back = F.concat(cell("translation"), F.when(cell("gloss") != "", F.concat(F.lit(" — "), cell("gloss"))).otherwise(""))
    source = F.trim(F.concat(cell("title"), F.when(F.col("page") > 0, F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("")))
    front = F.when(cell("surface") != "", cell("surface")).otherwise(cell("term"))
    rows = entries.select(F.col("id").cast("long").alias("at"), F.concat_ws("\t", front, back, cell("context"), cell("note"), source).alias("value"))
    head = entries.sparkSession.createDataFrame([(i - len(DECK_HEADER), x) for i, x in enumerate(DECK_HEADER)], "at long, value string")
    return head.unionByName(rows)


def un_formula(cell: Column) -> Column:
    """A cell without the quote that keeps a spreadsheet from running it."""
    return F.when(cell.rlike(r"^'+[=+\-@\t\r]"), F.substring(cell, 2, 1 << 30)).otherwise(cell)


def import_plan(rows: DataFrame, existing: DataFrame, now: int) -> DataFrame:
    """row, op, reason, id for each row of a file (row, id, surface, target, updated, flag and any of CONTENT) against the
    stored entries (id, term, target, updated and CONTENT).

    A row belongs to the entry with its id, if that has its target language, else to the entry with its term and target.
    add: there is none. same: nothing differs, or the entry is newer. change: the file is. conflict: the file's time cannot
    be read (time) or lies ahead (future). reject: flagged, without a term or target, or its entry or its term and target
    come up earlier in the file, or belong to another entry (dup).
    """
    fields = [c for c in CONTENT if c in rows.columns and c in existing.columns]
    r = rows.select("row", F.col("id").alias("fid"), "flag", "target", F.col("updated").alias("t"), term_key(F.col("surface")).alias("term"), *[field_value(c, F.col(c)).alias(f"f_{c}") for c in fields])
    r = r.withColumn("bad", F.when(F.col("flag").isNotNull(), F.col("flag")).when(F.col("term") == "", "term").when(F.coalesce("target", F.lit("")) == "", "target"))
    e = existing.select(F.col("id").alias("eid"), F.col("term").alias("eterm"), F.col("target").alias("etarget"), F.col("updated").alias("et"), *[field_value(c, F.col(c)).alias(f"e_{c}") for c in fields])
    by_id = e.select("eid", "etarget").withColumnRenamed("etarget", "id_target")
    by_key = e.groupBy("eterm", "etarget").agg(F.max("eid").alias("kid"))
    r = r.join(by_id, (F.col("fid") == F.col("eid")) & F.col("bad").isNull(), "left").withColumn("iid", F.when(F.col("id_target") == F.col("target"), F.col("eid"))).drop("eid", "id_target")
    r = r.join(by_key, (F.col("term") == F.col("eterm")) & (F.col("target") == F.col("etarget")) & F.col("bad").isNull(), "left").drop("eterm", "etarget")
    r = r.withColumn("hit", F.coalesce("iid", "kid"))
    mark = F.when(F.col("hit").isNotNull(), F.concat(F.lit("i"), F.col("hit").cast("string"))).otherwise(F.concat_ws("\u0001", F.lit("k"), "term", "target"))
    ok = F.col("bad").isNull()
    first = lambda *by: F.row_number().over(Window.partitionBy(ok, *by).orderBy("row"))
    r = r.withColumn("nth", F.greatest(first(mark), first("term", "target")))
    r = r.withColumn("bad", F.coalesce("bad", F.when((F.col("nth") > 1) | (F.col("kid").isNotNull() & (F.col("kid") != F.col("hit"))), "dup")))
    j = r.join(e, F.col("hit") == F.col("eid"), "left")
    differs = (F.col("term") != F.col("eterm")) if not fields else F.exists(F.array(F.col("term") != F.col("eterm"), *[F.col(f"f_{c}") != F.col(f"e_{c}") for c in fields]), lambda x: x)
    known = F.col("t").isNotNull() & (F.col("t") <= now)
    op = F.when(F.col("bad").isNotNull(), "reject").when(F.col("eid").isNull(), "add").when(~differs | (known & (F.col("t") < F.coalesce("et", F.lit(0)))), "same").when(known, "change").otherwise("conflict")
    out = j.select("row", op.alias("op"), F.when(F.col("bad").isNotNull(), F.col("bad")).when(op == "conflict", F.when(F.col("t").isNull(), "time").otherwise("future")).alias("reason"), F.when(F.col("bad").isNull(), F.col("eid")).alias("id"))
    return out


def to_apply(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """What to write: additions and changes, and of the conflicts those whose entry was chosen (id)."""
    picked = plan.where("op = 'conflict'").join(chosen.select("id").distinct(), "id", "left_semi")
    return plan.where("op IN ('add', 'change')").unionByName(picked.withColumn("op", F.lit("change")), allowMissingColumns=True)


def next_request(entries: DataFrame, most: int = BATCH) -> DataFrame:
    """The untranslated entries of the next request: those of the oldest one's document and target, oldest first."""
    todo = entries.where((F.col("kind") == "term") & (one_line(F.col("translation")) == "") & F.col("src").isNotNull() & (F.col("src") != F.col("target")))
    lead = todo.agg(F.min(F.struct("created", "id", "doc_id", "target")).alias("x")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.target").alias("target"))
    return todo.join(F.broadcast(lead), ["doc_id", "target"]).orderBy("created", "id").limit(most)  # lead is one row


def fill_back(cards: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """cards with the backs that they lack, where an answer (key, back) is known."""
    a = answers.groupBy(key).agg(F.first("back").alias("_back"))
    return cards.join(a, key, "left").withColumn("back", F.coalesce(F.nullif(F.trim("back"), F.lit("")), "_back", F.lit(""))).drop("_back")


def sentence_card(front: Column, back: Column, doc: Column, now: Column) -> Column:
    """A new card: due at once, never reviewed."""
    none = lambda t: F.lit(None).cast(t)
    state = F.struct(F.lit(2.5).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"))
    return F.struct(F.sha2(F.concat_ws("\u0001", doc.cast("string"), one_line(front)), 256).alias("id"), F.lit("sentence").alias("kind"), one_line(front).alias("front"), one_line(back).alias("back"), state.alias("sm2"), now.alias("dueAt"), none("timestamp").alias("reviewedAt"), now.alias("createdAt"))


def effective_links(links: Column, most: int = 12) -> Column:
    """Valid links (id, name, url), each id once, so many at most."""
    ok = F.filter(links, lambda x: (F.trim(F.coalesce(x["name"], F.lit(""))) != "") & x["url"].rlike(r"^https://[^/?#@]+[^\s]*\{q\}"))
    kept = F.aggregate(ok, F.slice(ok, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y["id"] == x["id"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, most)


def upsert_link(links: Column, link: Column) -> Column:
    """The list with the link in the place of the one with its id, or at the end."""
    there = F.exists(links, lambda x: x["id"] == link["id"])
    return F.when(there, F.transform(links, lambda x: F.when(x["id"] == link["id"], link).otherwise(x))).otherwise(F.concat(links, F.array(link)))
