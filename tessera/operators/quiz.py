"""Quizzes: sections of questions, which to ask, what an answer session leaves, and questions made by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import parse
from tessera.functions.text import number_tokens
from tessera.operators import ranges

#: Questions and share of verified ones that make a section worth a quiz; sections that an index keeps; pages of a window
#: and about a span; rows that a title is looked for in; paragraphs of one explanation; options of a made question.
LEAST, SHARE, SECTIONS, WINDOW, PAD, LOOK_BACK, EXPLANATION, OPTIONS = 5, 0.6, 200, 32, 1, 6, 30, 4


def window_of(page: Column, size: int = WINDOW) -> Column:
    return F.floor((page - 1) / size).cast("int")


def padded(start: Column, end: Column, pages: Column, pad: int = PAD) -> tuple[Column, Column]:
    return F.greatest(F.lit(1), start - pad), F.least(pages, end + pad)


def section_index(questions: DataFrame, answers: DataFrame, most: int = SECTIONS) -> DataFrame:
    """doc, section, title, start, end, questions, verified: sections with a question, by their first page. The pages of
    questions (doc, section, title, page, status) and answers (doc, section, page) make the span; of each document the
    ``most`` sections with most questions and answers are kept."""
    q = questions.select("doc", "section", "title", "page", F.lit(1).alias("q"), (F.col("status") == "verified").cast("int").alias("v"))
    a = answers.select("doc", "section", F.lit(None).cast("string").alias("title"), "page", F.lit(0).alias("q"), F.lit(0).alias("v"))
    g = q.unionByName(a).where("section IS NOT NULL").groupBy("doc", "section").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page"))).alias("title"), F.min("page").alias("start"), F.max("page").alias("end"), F.sum("q").alias("questions"), F.sum("v").alias("verified"), F.count("*").alias("weight"))
    top = Window.partitionBy("doc").orderBy(F.desc("weight"), "section")
    return g.withColumn("_r", F.row_number().over(top)).where((F.col("_r") <= most) & (F.col("questions") > 0)).drop("_r", "weight")


def worthy(questions: Column, verified: Column, least: int = LEAST, share: float = SHARE) -> Column:
    return (questions >= least) & (verified >= share * questions)


def question_record(doc: Column, section: Column, number: Column, stem: Column, options: Column, answer: Column, status: Column) -> Column:
    """A question as it is stored: its id follows from where it stands."""
    return F.struct(
        F.concat_ws("#", doc.cast("string"), section, number.cast("string")).alias("id"), F.lit("book").alias("source"), F.when(status == "verified", "verified").otherwise("unverified").alias("status"),
        F.coalesce(number, F.lit(0)).alias("number"), F.coalesce(stem, F.lit("")).alias("stem"), F.coalesce(options, F.array().cast("array<string>")).alias("options"), answer.alias("answer"),
    )


def ask(questions: DataFrame, last: DataFrame, key: str, wrong_only: bool = False) -> DataFrame:
    """questions (key, id, status) to ask, each id once: after a wrong-only wish those that the last attempt (key, id, correct)
    had wrong; else the verified ones, or all where none is, that it did not touch, or from the beginning if it touched all."""
    w = Window.partitionBy(key, "id").orderBy("seq")
    q = questions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if wrong_only:
        return q.join(last.where("correct = false").select(key, "id").distinct(), [key, "id"], "left_semi").select(questions.columns)
    all_ = Window.partitionBy(key)
    good = F.col("status") == "verified"
    q = q.withColumn("_any", F.max(good.cast("int")).over(all_)).where(good | (F.col("_any") == 0))
    q = q.join(last.select(key, "id").distinct().withColumn("_seen", F.lit(1)), [key, "id"], "left")
    q = q.withColumn("_left", F.min(F.coalesce("_seen", F.lit(0))).over(all_))
    return q.where(F.col("_seen").isNull() | (F.col("_left") == 1)).select(questions.columns)


def session(answers: DataFrame, questions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(attempts, mistakes) of answers (key, id, chosen, ms) to questions (id, answer, status): an answer to a question that
    cannot be graded counts as none, and of several to one question the first does."""
    first = answers.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "id").orderBy("seq"))).where("_r = 1")
    j = first.join(questions.select("id", "answer", "status"), "id").withColumn("correct", F.when(F.col("status") == "verified", F.col("chosen") == F.col("answer")))
    attempts = j.groupBy(*key).agg(F.count_if(F.col("correct")).alias("score"), F.count("correct").alias("total"), F.sum("ms").alias("ms"))
    return attempts, j.where("correct = false").select(*key, "id", "chosen")


def range_of(a: Column, b: Column) -> Column:
    """struct(lo, hi) of two pages in either order; null for pages below 1."""
    lo, hi = F.least(a, F.coalesce(b, a)), F.greatest(a, F.coalesce(b, a))
    return F.when(a.isNotNull() & (lo >= 1), F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))


def parse_range(key: Column) -> Column:
    """struct(lo, hi) of ``3-17``."""
    p = F.split(F.trim(key), "-")
    whole = F.trim(key).rlike("^[0-9]+-[0-9]+$")
    return F.when(whole, range_of(F.get(p, F.lit(0)).try_cast("long"), F.get(p, F.lit(1)).try_cast("long")))


def sections_in(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Sections (key, section, start, end) that share a page with a wanted range (key, lo, hi)."""
    return index.join(wanted, key).where((F.col("end") >= F.col("lo")) & (F.col("start") <= F.col("hi"))).select(key, "section", "lo", "hi")


def read_pages(read: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted (key, lo, hi) with ``n``: how many of its pages the read ranges (key, lo, hi) cover. Only what of them lies in
    wanted ranges is sorted and merged."""
    w = wanted.select(key, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    r = read.select(key, F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b")).where("a IS NOT NULL").join(w, key)
    cut = r.where(F.greatest("a", "_lo") <= F.least("b", "_hi")).withColumns({"a": F.greatest("a", "_lo"), "b": F.least("b", "_hi")})
    n = ranges.union(cut, [key, "_lo", "_hi"], "a", "b").groupBy(key, F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    return wanted.join(n, [key, "lo", "hi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def titles(paras: DataFrame, key: str, heading: Column, section: Column) -> DataFrame:
    """paras with ``title``: the nearest section heading among the LOOK_BACK paragraphs before, else the nearest heading."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(-LOOK_BACK, -1)
    return paras.withColumn("title", F.coalesce(F.last(F.when(section, F.col("text")), True).over(w), F.last(F.when(heading, F.col("text")), True).over(w)))


def explanations(paras: DataFrame, key: str, answer: Column, stop: Column, most: int = EXPLANATION) -> DataFrame:
    """key, seq, n, text: each answer's paragraph and those after it, up to the next answer or stop, ``most`` of them at most."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = paras.withColumn("_a", answer).withColumn("_edge", answer | stop).withColumn("_run", F.sum(F.col("_edge").cast("int")).over(w))
    run = Window.partitionBy(key, "_run").orderBy("seq")
    p = p.withColumn("_n", F.row_number().over(run)).withColumn("_head", F.first(F.struct("_a", "seq")).over(run)).where(F.col("_head._a") & (F.col("_n") <= most + 1))
    return p.groupBy(key, F.col("_head.seq").alias("seq")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n").alias("text"))


def found_ahead(paras: DataFrame, key: str, wanted: Column, label: Column, reach: int) -> Column:
    """Does a question with the wanted label stand among the ``reach`` paragraphs from this one on? Over paras by key and seq."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(0, reach - 1)
    return F.array_contains(F.collect_set(label).over(w), wanted)


def store_made(stored: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """stored (key, id, status, number) and newly made questions (key, seq, stem, status) as one: an id is made of the stem, so
    one stem is one question; a verified one never falls back; new ones are numbered on from the greatest number."""
    m = made.withColumn("id", F.sha2(F.concat_ws("\u0001", F.col(key).cast("string"), F.trim("stem")), 256))
    m = m.groupBy(key, "id").agg(F.min("seq").alias("seq"), F.max((F.col("status") == "verified").cast("int")).alias("v"))
    s = stored.select(key, "id", "number", (F.col("status") == "verified").cast("int").alias("sv"))
    j = s.join(m, [key, "id"], "full")
    top = F.coalesce(F.max("number").over(Window.partitionBy(key)), F.lit(0))
    new = F.row_number().over(Window.partitionBy(key, F.col("number").isNull()).orderBy("seq"))
    status = F.when(F.greatest(F.coalesce("sv", F.lit(0)), F.coalesce("v", F.lit(0))) == 1, "verified").otherwise("rejected")
    return j.select(key, "id", status.alias("status"), F.coalesce("number", top + new).cast("long").alias("number"))


def sent_before(history: DataFrame, key: str) -> DataFrame:
    """key, para, n: how often each paragraph was sent; one batch counts once however many questions came of it."""
    once = history.dropDuplicates([key, "batch"])
    return once.select(key, F.explode("paras").alias("para")).groupBy(key, "para").agg(F.count("*").alias("n"))


def passages(paras: DataFrame, read: DataFrame, sent: DataFrame, summarised: DataFrame, key: str) -> DataFrame:
    """Paragraphs (key, page, para) to ask about next, with ``place``: on read pages and never sent, those without a summary
    first."""
    p = paras.join(read.select(key, "page").distinct(), [key, "page"], "left_semi").join(sent.select(key, "para"), [key, "para"], "left_anti")
    p = p.join(summarised.select(key, "para").distinct().withColumn("_s", F.lit(1)), [key, "para"], "left")
    return p.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("_s", F.lit(0)), "page", "para"))).drop("_s")


def grounded(made: DataFrame, key: str) -> DataFrame:
    """made (key, seq, stem, options, answer, quote, source) with status and reason: rejected for a missing stem, options that
    are too few or alike, an answer that is none of them, a stem that came before, numbers that the source lacks, or a quote
    that it does not hold."""
    opts = F.transform("options", lambda x: F.lower(F.trim(x)))
    text = F.concat_ws(" ", F.col("stem"), F.array_join("options", " "))
    again = F.row_number().over(Window.partitionBy(key, F.lower(F.trim("stem"))).orderBy("seq")) > 1
    m = made.withColumn("_again", again).withColumn("_how", parse.evidence("source", "quote"))
    reason = (
        F.when(F.trim(F.coalesce("stem", F.lit(""))) == "", "stem")
        .when((F.size(opts) != OPTIONS) | F.exists(opts, lambda x: x == ""), "options")
        .when(F.size(F.array_distinct(opts)) < F.size(opts), "alike")
        .when(~F.coalesce(F.ascii("answer").between(65, 64 + OPTIONS) & (F.length("answer") == 1), F.lit(False)), "answer")
        .when(F.col("_again"), "dup")
        .when(F.size(F.array_except(number_tokens(text), number_tokens(F.col("source")))) > 0, "digits")
        .when(F.col("_how").isNull(), "evidence")
    )
    return m.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "verified").otherwise("rejected")).drop("_again", "_how")
