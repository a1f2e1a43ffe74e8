"""Questions, options and answers out of ordered paragraphs, as windows over (doc, seq, text).

A paragraph's beginning is read in two steps: label() takes a number such as ``12`` or ``IV-12`` apart, and letters() reads
a list of letters word by word. Single answers, lists of answers, bare labels and answers without a number all use these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import let

_SAYS = r"the\s+answers?\s+(?:is|are)\s+"
_LABEL = "(?:[IVXLC]{1,5}-)?[0-9]{1,3}"
#: One label and one letter, after which no other may follow: what most answers are, read without splitting.
_ONE = rf"(?i)\A *({_LABEL}) *\.\s+{_SAYS}([A-J])(?:[^\w\s,&]|\s++(?!and|[,&])|\s*\z)"


def _label(x: Column) -> Column:
    """struct(section, number) of a label in capitals."""
    section = F.nullif(F.regexp_extract(x, "^([IVXLC]{1,5})-", 1), F.lit(""))
    return F.struct(section.alias("section"), F.substring_index(x, "-", -1).cast("int").alias("number"))


def label(token: Column) -> Column:
    """struct(section, number) of ``12`` or ``IV-12``, else null."""
    return let(F.upper(F.trim(token)), lambda x: F.when(x.rlike(f"^{_LABEL}$"), _label(x)))


def letters(raw: Column) -> Column:
    """Letters A to J that a text begins with, parted by commas, & or "and"; a letter with another mark is the last."""
    words = F.filter(F.split(F.regexp_replace(raw, "[,&]", " , "), r"\s+"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        part = F.lower(w).isin(",", "and")
        one = w.rlike(r"^[A-Ja-j](?!\w)")
        got = F.struct(F.concat(acc["l"], F.array(F.upper(F.substring(w, 1, 1)))).alias("l"), F.when(F.length(w) == 1, 1).otherwise(2).alias("at"))
        wait = F.struct(acc["l"].alias("l"), F.lit(0).alias("at"))
        stop = F.struct(acc["l"].alias("l"), F.lit(2).alias("at"))
        return F.when(acc["at"] == 2, acc).when((acc["at"] == 0) & one, got).when(part & (F.size(acc["l"]) > 0), wait).otherwise(stop)

    return F.coalesce(F.aggregate(words, F.struct(none.alias("l"), F.lit(0).alias("at")), step)["l"], none)


def _rest(text: Column) -> Column:
    """What follows the first word; null if nothing does."""
    return F.nullif(F.get(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+", 2), F.lit(1)), F.lit(""))


def _begins(text: Column, after: str) -> Column:
    """The label of a first word that ends in a full stop, with ``after`` behind it."""
    found = F.upper(F.regexp_extract(text, rf"(?iu)\A *({_LABEL})\.{after}", 1))
    return F.when(found != "", _label(found))


def question_label(text: Column) -> Column:
    """struct(section, number) of a paragraph that a number and a full stop begin, and that goes on."""
    return _begins(text, r"\s+\S")


def bare_label(text: Column) -> Column:
    """struct(section, number) of a paragraph that is nothing but a number and a full stop."""
    return _begins(text, r"\s*\z")


def option_letter(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\A *([A-E])\.\s+\S", 1), F.lit(""))


def headless_answer(text: Column) -> Column:
    """Letters of "The answer is A", which no number begins; null for anything else."""
    says = rf"(?i)^\s*{_SAYS}"
    got = let(letters(F.get(F.split(text, says, 2), F.lit(1))), lambda x: F.when(F.size(x) > 0, x))
    return F.when(text.rlike(says), got)


def answer_list(text: Column) -> Column:
    """array(struct(section, number, letters)) of "3. The answers are A and C" or "1, 2 and 3. The answers are A, B and C";
    a list needs as many letters as numbers, and all or none of them with a section. Null for anything else; whatever
    lacks the words is so at once."""
    says = rf"(?i)\.\s+{_SAYS}"
    tokens = lambda x: F.filter(F.split(x, r"(?i)\s*(?:,|\band\b)\s*"), lambda t: F.trim(t) != "")

    def of(x: Column) -> Column:
        named, got, n = x["named"], x["got"], F.size(x["named"])
        right = (F.size(got) > 0) & F.forall(named, lambda k: k.isNotNull())
        roman = F.size(F.filter(named, lambda k: k["section"].isNotNull()))
        one = F.transform(named, lambda k: F.struct(k["section"].alias("section"), k["number"].alias("number"), got.alias("letters")))
        many = F.zip_with(named, got, lambda k, y: F.struct(k["section"].alias("section"), k["number"].alias("number"), F.array(y).alias("letters")))
        return F.when(right & (n == 1), one).when(right & (n > 1) & (n == F.size(got)) & ((roman == 0) | (roman == n)), many)

    read = lambda parts: F.struct(F.transform(tokens(F.get(parts, F.lit(0))), label).alias("named"), letters(F.get(parts, F.lit(1))).alias("got"))
    part = lambda i: F.upper(F.regexp_extract(text, _ONE, i))
    k = _label(part(1))
    single = F.array(F.struct(k["section"].alias("section"), k["number"].alias("number"), F.array(part(2)).alias("letters")))
    return F.when(text.rlike(_ONE), single).when(text.rlike(says), let(let(F.split(text, says, 2), read), of))


def answers(paras: DataFrame) -> DataFrame:
    """doc, seq, section, number, letters of the paragraphs that name answers."""
    return paras.select("doc", "seq", F.inline(answer_list(F.col("text"))))


def orphan_answers(paras: DataFrame) -> DataFrame:
    """doc, seq, section, number, letters of answers that lost their numbers; paras has page and kind besides.

    On one page, bare labels stand first, with headings at most between them, of one section and in unbroken order; after
    the last, answers without a number follow, up to the next question or numbered answer. As many labels as answers:
    they belong together in order. Else none does.
    """
    t = F.col("text")
    page = Window.partitionBy("doc", "page")
    rows = paras.withColumn("_label", bare_label(t)).withColumn("_answer", answer_list(t)).withColumn("_head", headless_answer(t))
    rows = rows.withColumn("_other", F.col("_answer").isNotNull() | question_label(t).isNotNull() | option_letter(t).isNotNull())
    rows = rows.withColumn("_label", F.when(~F.col("_other"), F.col("_label")))
    at = F.when(F.col("_label").isNotNull(), F.col("seq"))
    rows = rows.withColumn("_from", F.min(at).over(page)).withColumn("_to", F.max(at).over(page))
    end = F.min(F.when((F.col("seq") > F.col("_to")) & (F.col("_answer").isNotNull() | question_label(t).isNotNull()), F.col("seq"))).over(page)
    rows = rows.withColumn("_end", end)
    before = F.lag("_label").over(Window.partitionBy("doc", "page", F.col("_label").isNotNull()).orderBy("seq"))
    torn = F.col("seq").between(F.col("_from"), F.col("_to")) & F.col("_label").isNull() & ~F.col("kind").eqNullSafe("heading")
    leap = F.col("_label").isNotNull() & before.isNotNull() & ~((F.col("_label.number") == before["number"] + 1) & F.col("_label.section").eqNullSafe(before["section"]))
    rows = rows.withColumn("_bad", (torn | leap).cast("int"))
    found = (F.col("seq") > F.col("_to")) & F.col("_head").isNotNull() & (F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    rows = rows.withColumn("_found", F.coalesce(found, F.lit(False)))
    n = F.count(at).over(page)
    rows = rows.withColumn("_good", (F.max("_bad").over(page) == 0) & (n > 0) & (n == F.count(F.when(F.col("_found"), 1)).over(page))).where("_good")
    place = lambda c: F.row_number().over(Window.partitionBy("doc", "page").orderBy("seq")).alias(c)
    names = rows.where("_label IS NOT NULL").select("doc", "page", place("_k"), "_label.section", "_label.number")
    heads = rows.where("_found").select("doc", "page", place("_k"), "seq", F.col("_head").alias("letters"))
    return heads.join(names, ["doc", "page", "_k"]).select("doc", "seq", "section", "number", "letters")


def questions(paras: DataFrame) -> DataFrame:
    """doc, seq, section, number, stem, options (letter, text): a question goes on to its options, which must run from A
    without a gap; a plain paragraph between two options belongs to the one before; a question has two options at least."""
    t = F.col("text")
    answer = F.col("_answer")
    p = paras.withColumn("_answer", answer_list(t)).withColumn("_label", question_label(t)).withColumn("letter", option_letter(t))
    p = p.withColumn("kind", F.when(answer.isNotNull(), "answer").when(F.col("_label").isNotNull(), "question").when(F.col("letter").isNotNull(), "option").otherwise("plain"))
    p = p.withColumn("letter", F.when(F.col("kind") == "option", F.col("letter")))
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("head", F.max(F.when(F.col("kind").isin("question", "answer"), F.struct("seq", "kind", "_label"))).over(w)).where("head.kind = 'question'")
    q = Window.partitionBy("doc", "head.seq").orderBy("seq")
    run = q.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("n", F.count("letter").over(run))  # options so far
    p = p.withColumn("right", F.col("letter").isNull() | (F.ascii("letter") == F.lit(64) + F.col("n")))
    p = p.withColumn("ok", F.min(F.col("right").cast("int")).over(run) == 1).where("ok")
    p = p.withColumn("more", F.max("n").over(q.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = p.where((F.col("n") < F.col("more")) | (F.col("letter").isNotNull()) | (F.col("n") == 0))  # what follows the last option is not its
    body = F.when(F.col("kind").isin("option", "question"), _rest(t)).otherwise(F.trim(t))
    part = p.groupBy("doc", F.col("head.seq").alias("seq"), F.col("head._label").alias("label"), "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", body.alias("x")))), lambda r: r["x"]), " ").alias("x"))
    out = part.groupBy("doc", "seq", "label").agg(F.max(F.when(F.col("n") == 0, F.col("x"))).alias("stem"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(F.char(F.col("n") + 64).alias("letter"), F.col("x").alias("text"))))).alias("options"))
    return out.where(F.size("options") >= 2).select("doc", "seq", "label.section", "label.number", "stem", "options")


def verified(paras: DataFrame) -> DataFrame:
    """questions() with answer and status: verified if one answer names them and all its letters are options. Where paras
    has page and kind, answers that lost their numbers count too."""
    found = answers(paras)
    if {"page", "kind"} <= set(paras.columns):
        found = found.unionByName(orphan_answers(paras))
        paras = paras.drop("kind")
    a = found.groupBy("doc", "section", "number").agg(F.min_by("letters", "seq").alias("answer"), F.count("*").alias("n"))
    a = a.select(F.col("doc").alias("d"), F.col("section").alias("s"), F.col("number").alias("k"), "answer", "n")
    q = questions(paras)
    j = q.join(a, (q.doc == a.d) & q.section.eqNullSafe(a.s) & (q.number == a.k), "left")
    good = (F.col("n") == 1) & (F.size("answer") > 0) & (F.size(F.array_except("answer", F.col("options.letter"))) == 0)
    return j.select("doc", "seq", "section", "number", "stem", "options", "answer", F.when(good, "verified").otherwise("unverified").alias("status"))


def gradable(status: Column, answer: Column) -> Column:
    """Only a verified question with an answer is graded."""
    return (status == "verified") & (F.size(answer) > 0)
