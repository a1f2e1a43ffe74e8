"""Scripts, languages of units, speech and texts in two directions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import count_of

#: Letters below which a unit's language is not told, and the share of runs that tells it; pages and characters of a sample,
#: and characters of a page that counts.
LETTERS, SHARE_OF, SHARE, PAGES, CHARS, PAGE_CHARS = 2, 5, 3, 30, 8000, 200
_SCRIPTS = {"hangul": "IsHangul", "arabic": "IsArabic", "latin": "IsLatin"}
_LANGUAGE = {"hangul": "ko", "arabic": "ar"}
#: Languages in Latin letters; symbols as words in English speech (fixed values).
LATIN = ("en", "fr", "es")
SYMBOLS = {"≥": "greater than or equal to", "≤": "less than or equal to", "±": "plus or minus", "µ": "micro", "μ": "micro", "→": "to", "%": "percent"}


def at_least(part: Column, whole: Column, num: int, den: int) -> Column:
    """part / whole >= num / den, in whole numbers."""
    return (whole > 0) & (part * den >= whole * num)


def script_runs(text: Column) -> dict[str, Column]:
    """By script: letters, and runs of them. Marks belong to the letter before and end no run; anything else does."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}", "")
    out = {}
    for name, p in _SCRIPTS.items():
        letter = rf"[\p{{L}}&&\p{{{p}}}]"
        out |= {f"{name}_letters": count_of(t, letter), f"{name}_runs": count_of(t, letter + "+")}
    return out


def unit_language(text: Column, doc_lang: Column) -> Column:
    """The language that a unit of text is to be read in where that is not the document's; null: the document's, too few
    letters, or no script with three fifths of the runs."""
    c = script_runs(text)
    n = [c[f"{s}_runs"] for s in _SCRIPTS]
    total, letters = sum(n[1:], n[0]), sum((c[f"{s}_letters"] for s in list(_SCRIPTS)[1:]), c["hangul_letters"])
    doc = F.coalesce(F.nullif(doc_lang, F.lit("")), F.lit("en"))
    lang = F.lit(None).cast("string")
    for s, x in zip(_SCRIPTS, n):
        rest = [y for y in n if y is not x]
        alone = (x > rest[0]) & (x > rest[1])
        own = F.lit(_LANGUAGE[s]) if s in _LANGUAGE else F.when(doc.isin(*LATIN), doc).otherwise("en")
        lang = F.when(alone & at_least(x, total, SHARE, SHARE_OF), own).otherwise(lang)
    return F.when((letters >= LETTERS) & (lang != doc), lang)


def sample(paras: DataFrame, key: str) -> DataFrame:
    """key, text, pages: a document's first pages as a sample for guessing its language: body paragraphs in order, as many as
    CHARS characters take, and how many of the pages have enough text. paras: key, page, seq, kind, text."""
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    p = paras.where((F.col("page").between(1, PAGES)) & ~F.col("kind").eqNullSafe("heading")).select(key, "page", "seq", t.alias("t")).where("t <> ''")
    w = Window.partitionBy(key).orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    full = p.groupBy(key, "page").agg((F.sum(F.length("t") + 1) - 1).alias("n")).groupBy(key).agg(F.count_if(F.col("n") >= PAGE_CHARS).alias("pages"))
    some = p.withColumn("before", F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))).where(F.col("before") < CHARS)
    text = some.groupBy(key).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "t"))), lambda x: x["t"]), " "), 1, CHARS).alias("text"))
    return text.join(full, key)


def mismatch(query: Column, doc_lang: Column) -> Column:
    """Is a query written in another script than the document? Not if any of its letters is of the document's."""
    want = F.when(doc_lang == "ko", "hangul").when(doc_lang == "ar", "arabic").when(doc_lang.isin("en", "fr"), "latin")
    has = {n: F.coalesce(query, F.lit("")).rlike(rf"[\p{{L}}&&\p{{{p}}}]") for n, p in _SCRIPTS.items()}
    cjk = F.coalesce(query, F.lit("")).rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    own = F.when(want == "hangul", has["hangul"]).when(want == "arabic", has["arabic"]).otherwise(has["latin"])
    return F.coalesce(want.isNotNull() & ~own & (has["hangul"] | has["arabic"] | has["latin"] | cjk), F.lit(False))


_LEFT = r"\([^()]*\p{IsLatin}[^()]*\)|\p{IsLatin}[\p{IsLatin}0-9]*(?:[ ./'’-][\p{IsLatin}0-9]+)*"


def direction_runs(text: Column) -> Column:
    """array(text, ltr): a text in two directions as its parts, in order: Latin words (or brackets that hold some), the rest."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({_LEFT})", "\x01\x02$1\x01"), "\x01"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_replace(x, "^\x02", "").alias("text"), x.startswith("\x02").alias("ltr")))


def term_in_translation(term: Column, translation: Column) -> Column:
    """Up to four words before the brackets that hold the term in a translation: what it may be called there. Null: no such
    brackets, or nothing before them."""
    pattern = F.concat(F.lit(r"(?iU)((?:[^\s.,;:!?()]+\s+){0,3}[^\s.,;:!?()]+)\s*\([^()]*\b\Q"), F.trim(term), F.lit(r"\E\b[^()]*\)"))
    return F.when(F.trim(term) != "", F.nullif(F.call_function("regexp_extract", translation, pattern, F.lit(1)), F.lit("")))


def fold_arabic(text: Column) -> Column:
    """Without vowel marks and stretching; forms of alef, teh marbuta and alef maksura as the plain letters."""
    t = F.regexp_replace(text, r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]", "")
    return F.translate(t, "أإآٱةى", "ااااهي")


def speech(text: Column, symbols: dict[str, str] | None = None, blank: str = "blank") -> Column:
    """A text to be spoken: gaps to fill as a word, footnote marks gone (a star between letters stays), addresses as "link",
    symbols as words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"_{3,}|-{5,}", f" {blank} ")
    t = F.regexp_replace(F.translate(t, "∗", "*"), r"(?<![\p{L}\p{N}])[*†‡§]|[*†‡§](?![\p{L}\p{N}])", "")
    t = F.regexp_replace(t, r"(?i)\bhttps?://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.[\w.]+", "link")
    for k, v in (SYMBOLS if symbols is None else symbols).items():
        t = F.regexp_replace(t, re.escape(k), f" {v} ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def commands(heard: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """key, command, rank of utterances heard as ranked alternatives (key, rank, text) by a table (phrase, command): the first
    alternative that is one phrase, of one command only, counts; numbers, case and marks do not."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{N}+", " "), r"[^\p{L}]+", " "))
    t = table.groupBy(plain(F.col("phrase")).alias("_p")).agg(F.min("command").alias("command"), F.max("command").alias("_m")).where("command = _m").drop("_m")
    h = heard.withColumn("_p", plain(F.col("text"))).where("_p <> ''").join(t, "_p")
    return h.groupBy(key).agg(F.min_by("command", "rank").alias("command"), F.min("rank").alias("rank"))
