"""Citations among sentences, as column expressions over (doc, seq, text).

A sentence is weighed by what is left of it: identifiers, dated issues, names with initials and "et al" are taken out one
kind after another, each leaving a mark, and what remains is judged. Running words (small letters) mean prose; a few
capitalised words are the title of a journal. Reading too much aloud costs less than leaving prose out, so doubt is prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longest sentence that may be a citation; sentences that a reference's head reaches forward, and their characters.
MOST_CHARS, FOLLOW, RUN_CHARS = 200, 4, 400
#: Capitalised words that a journal's title may have.
TITLE_WORDS = 12

#: What is taken out, in this order: (its mark, what it looks like). A name is words that begin with a capital and end in
#: initials; an issue begins with a year and goes on in figures, months and page marks.
_MARKS = (
    ("@", r"(?i)\[?(?<![a-z0-9])(?:pmid|pmcid|doi)[ :]*(?:pmc)?[0-9][^ ,;\]]{4,}\]?"),
    ("=", r"(?<!\p{L})et al(?!\p{L})\.?"),
    ("%", r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ .;:,]+(?:[0-9(e]|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[^ ;,\[]*)*"),
    ("+", r"(?<!\p{L})(?:\p{Lu}[\p{L}'’-]*\p{Ll}[\p{L}'’-]*[ -]){1,3}(?=\p{Lu})[\p{Lu}-]{1,6}(?![\p{L}\p{N}])"),
)
_KEPT = "@=%+"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def reduced(text: Column) -> Column:
    """The sentence with a mark in the place of each part of a citation."""
    s = F.translate(squeezed(text), _KEPT, "    ")
    for mark, p in _MARKS:
        s = F.regexp_replace(s, p, mark)
    return s


def _count(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def citation_kind(text: Column) -> Column:
    """id, etal or etal+id if all of a sentence is a citation, else null: nothing but marks, few capitalised words and
    punctuation is left, and it names a source (an identifier, or names with "et al" at its beginning)."""
    s = reduced(text)
    prose = s.rlike(r"(?<![\p{L}\p{N}])\p{Ll}|[^\x00-\x7f\p{L}–—’•·▪]|[0-9]")
    title = _count(s, r"\p{Lu}[\p{L}'’-]*")
    named, known = s.rlike(r"^[^\p{L}=%]*\+[+, ]*="), s.contains("@")
    loose = (title > 0) & ~s.contains("+")  # capitalised words without a name are a heading
    kind = F.when(named & known, "etal+id").when(named, "etal").when(known & ~s.contains("="), "id")
    return F.when(F.length(squeezed(text)).between(1, MOST_CHARS) & ~prose & (title <= TITLE_WORDS) & ~loose, kind)


def is_id_only(text: Column) -> Column:
    """Identifiers and punctuation alone."""
    s = reduced(text)
    return s.contains("@") & ~s.rlike(r"[\p{L}\p{N}=%+]")


def is_reference_head(text: Column) -> Column:
    """Begins with names that "et al" or a stop closes and something follows; not a citation as a whole."""
    return citation_kind(text).isNull() & reduced(text).rlike(r"^(?:[0-9]{1,3}\. ?)?\+(?:, ?\+){0,5}(?:,? ?=|\.).*[\p{L}\p{N}%@]")


def _issue(text: Column) -> tuple[Column, Column, Column]:
    """Of ``date;volume(issue):pages``: the date, the volume with its issue, the pages (null without a colon)."""
    halves = F.split(F.regexp_replace(squeezed(text), r"\.$", ""), ";")
    rest = F.split(F.trim(F.get(halves, F.lit(1))), ":")
    return F.when(F.size(halves) == 2, F.get(halves, F.lit(0))), F.get(rest, F.lit(0)), F.when(F.size(rest) == 2, F.get(rest, F.lit(1)))


def _dated(date: Column) -> Column:
    """A year, perhaps with a month's three letters and a day."""
    return date.rlike(r"^[0-9]{4}( \p{Lu}\p{Ll}{2}\.?( [0-9]{1,2})?)?$")


def is_publication_only(text: Column) -> Column:
    """Nothing but an issue in figures: letters are a month after the year, and an e before the pages."""
    date, volume, pages = _issue(text)
    month = F.lower(F.regexp_extract(date, r"\p{L}+", 0))
    return F.coalesce(_dated(date) & ((month == "") | month.isin(*_months())) & ~volume.rlike(r"\p{L}") & volume.rlike("^[0-9]") & F.regexp_replace(F.trim(pages), "^e", "").rlike(r"^[0-9][0-9–-]*$"), F.lit(False))


def _months() -> list[str]:
    import calendar

    return [m.lower() for m in calendar.month_abbr if m]


def closes(text: Column) -> Column:
    """Publication data that end a reference: pages may be absent or hold letters."""
    date, volume, pages = _issue(text)
    one_colon = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) <= 1
    return F.coalesce(one_colon & _dated(date) & volume.rlike(r"^[0-9]+(\([^()]+\))?$") & (pages.isNull() | F.trim(pages).rlike(r"^[\w–-]+$")), F.lit(False))


def mark_references(sentences: DataFrame, key: str | list[str] = "doc") -> DataFrame:
    """sentences with kind and reference: citations, what stands between a reference's head and its close (an identifier
    or publication data within FOLLOW sentences and RUN_CHARS characters, and no other citation before it), and publication
    data right before an identifier. ``key`` names a paragraph: nothing reaches over its end.

    Each sentence looks ahead for the next close and the next stop by their numbers, and a running sum of characters says
    how far the close is; sentences up to the furthest close that a head before them found are covered."""
    t = F.col("text")
    by = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*by).orderBy("seq")
    ahead, behind = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    s = sentences.withColumn("kind", citation_kind(t)).withColumn("_n", F.row_number().over(w)).withColumn("_chars", F.sum(F.length("text")).over(behind))
    cited, sole = F.col("kind").isNotNull(), is_id_only(t)
    end = F.struct(F.col("_n").alias("n"), F.col("_chars").alias("chars"))
    s = s.withColumn("_close", F.when(closes(t) | (cited & sole), end)).withColumn("_stop", F.when(cited & ~sole, F.col("_n")))
    s = s.withColumn("_next", F.first("_close", True).over(ahead)).withColumn("_block", F.first("_stop", True).over(ahead))
    near = (F.col("_next.n") - F.col("_n") <= FOLLOW) & (F.col("_next.chars") - F.col("_chars") + F.length("text") <= RUN_CHARS) & (F.coalesce("_block", F.lit(2**31 - 1)) > F.col("_next.n"))
    last = F.when(closes(F.substring_index(t, " ", -1)), F.col("_n")).when(near, F.col("_next.n"))
    covered = F.max(F.when(is_reference_head(t), last)).over(behind) >= F.col("_n")
    tail = is_publication_only(t) & (F.lead("kind").over(w) == "id")
    return s.withColumn("reference", cited | F.coalesce(covered, F.lit(False)) | F.coalesce(tail, F.lit(False))).drop("_n", "_chars", "_close", "_stop", "_next", "_block")
