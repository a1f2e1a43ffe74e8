"""Text functions as column expressions; offsets count code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words by language (fixed values); `la` is shared by two of them.
FUNCTION_WORDS = {
    "en": "the and of to is in with for".split(),
    "fr": "le la les des est et une du pour dans".split(),
    "es": "el los las del por para con una lo".split(),
}
#: Shapes of secrets (fixed values).
SECRETS = [r"AIza[0-9A-Za-z_\-]{30,}", r"AQ\.[\x21\x23-\x26\x28-\x3B\x3D\x3F-\x5F\x61-\x7E]{20,}", r"Bearer\s+\S+", r"sk-[A-Za-z0-9_\-]{16,}"]
_DASHES = "-­‐‑‒–—―−"
_QUOTES = {"‘’‛′": "'", "“”‟″": '"'}


def let(value: Column, f) -> Column:
    """f(value) with the value found once: what a lambda takes from outside as an expression is found anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold_char(c: str) -> str:
    """One character to one: wide forms to ASCII, lower case, Latin accents off, dashes to blanks, quotes to straight ones."""
    k = ord(c)
    x = chr(k - 0xFEE0) if 0xFF01 <= k <= 0xFF5E else " " if k == 0x3000 else c
    low = x.lower()
    x = low if len(low) == 1 else x
    d = unicodedata.normalize("NFD", x)
    if len(d) > 1 and "a" <= d[0] <= "z" and all(unicodedata.category(m)[0] == "M" for m in d[1:]):
        x = d[0]
    if x in _DASHES:
        return " "
    for marks, plain in _QUOTES.items():
        if x in marks:
            return plain
    return x


def fold_table() -> tuple[str, str]:
    """All characters of the basic plane that folding changes, and what they become: a table made by the rule."""
    pairs = [(chr(k), y) for k in range(1, 0x10000) if not 0xD800 <= k <= 0xDFFF and (y := fold_char(chr(k))) != chr(k)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD = fold_table()


def fold(text: Column) -> Column:
    """Length-preserving fold for search: every offset in the result is one in the text."""
    return F.translate(text, *FOLD)


def head_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def characters_of(text: Column, kind: str) -> Column:
    """How many characters of a text are of a kind (a pattern for one): by what is left without them, as a match for each run
    costs far less than one for each character."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"(?:{kind})+", "")), F.lit(0))


def beyond_latin(text: Column) -> Column:
    """Does a text hold any character from Arabic on? If not, no script but Latin needs counting."""
    return F.coalesce(text.rlike(r"[\x{0600}-\x{10FFFF}]"), F.lit(False))


def script_counts(text: Column, beyond: Column | None = None) -> dict[str, Column]:
    """Letters by script; a letter of several counts once, in the order Hangul, kana, Han, Arabic, Latin. ``beyond`` is
    beyond_latin() where it is at hand as a column."""
    letter = lambda s: rf"[\p{{L}}&&{s}]"
    some = beyond_latin(text) if beyond is None else beyond
    other = lambda s: F.when(some, characters_of(text, letter(s))).otherwise(0)
    return {
        "letters": characters_of(text, r"\p{L}"),
        "hangul": other(r"\p{IsHangul}"),
        "kana": other(r"[\p{IsHiragana}\p{IsKatakana}]"),
        "han": other(r"\p{IsHan}"),
        "arabic": other(r"\p{IsArabic}"),
        "latin": characters_of(text, letter(r"\p{IsLatin}")),
    }


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))


def function_words(words: Column) -> dict[str, Column]:
    """Of the words of letter_words(): how many, and how many are function words of each language. A Spanish one that begins
    with a capital (and is not all capitals) counts only before a word in lower case; fr_es is French without the word it
    shares with Spanish."""
    among = lambda xs: F.size(F.filter(words, lambda x: F.lower(x).isin(*xs)))

    def spanish(all_: Column) -> Column:
        def counts(x: Column, i: Column) -> Column:
            titled = F.substring(x, 1, 1).rlike(r"\p{Lu}") & (x != F.upper(x))
            return F.lower(x).isin(*FUNCTION_WORDS["es"]) & (~titled | F.coalesce(F.get(all_, i + 1).rlike(r"^\p{Ll}"), F.lit(False)))

        return F.size(F.filter(all_, counts))

    return {"words": F.size(words), "en": among(FUNCTION_WORDS["en"]), "fr": among(FUNCTION_WORDS["fr"]), "fr_es": among([w for w in FUNCTION_WORDS["fr"] if w != "la"]), "es": let(words, spanish)}


#: Java looks behind by code points only if the pattern itself holds a character beyond the basic plane; this one is a letter.
_AFTER_NO_LETTER = "(?<![\\p{L}\U00010000])"


def found_words(text: Column) -> Column:
    """The function words of all languages in a text, in lower case."""
    words = "|".join(sorted({w for ws in FUNCTION_WORDS.values() for w in ws}))
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{_AFTER_NO_LETTER}(?i:{words})(?!\p{{L}})"), F.lit(0)), F.lower)


def found_function_words(text: Column, found: Column) -> dict[str, Column]:
    """function_words() by found_words() of a text, without its other words. A Spanish one that begins with a capital, but is not
    all capitals, and that no word in lower case follows is taken off again."""
    among = lambda xs: F.size(F.filter(found, lambda x: x.isin(*xs)))
    titled = rf"{_AFTER_NO_LETTER}(?=\p{{Lu}})(?!\p{{Lu}}+(?!\p{{L}}))(?i:{'|'.join(FUNCTION_WORDS['es'])})(?!\p{{L}})(?!\P{{L}}+\p{{Ll}})"
    spanish = among(FUNCTION_WORDS["es"])
    return {"en": among(FUNCTION_WORDS["en"]), "fr": among(FUNCTION_WORDS["fr"]), "fr_es": among([w for w in FUNCTION_WORDS["fr"] if w != "la"]), "es": spanish - F.when(spanish > 0, count_of(text, titled)).otherwise(0)}


def with_language(df: DataFrame, text: str) -> DataFrame:
    """Adds guess and score: by script from three tenths of the letters up, else by function words at twice the rival's
    rate. Counts are columns of their own below, so each pattern passes a text once; letters are only counted where a script
    but Latin may have some, and function words where none of these decides."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s{2,}|[^\S ]", " "))  # a blank alone stays as it is
    d = df.withColumn("_t", t)
    d = d.withColumn("_beyond", beyond_latin(F.col("_t")) & (F.length("_t") >= 200))
    scripts = script_counts(F.col("_t"), F.col("_beyond"))
    scripts["letters"] = F.when(F.col("_beyond"), scripts["letters"]).otherwise(0)
    d = d.withColumns({f"_{k}": c for k, c in scripts.items()})
    c = {k: F.col(f"_{k}") for k in scripts}
    enough = lambda x: (c["letters"] > 0) & (x * 10 >= c["letters"] * 3)
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    share = lambda x: three(x / c["letters"])
    kana = (c["kana"] > 0) & enough(c["kana"] + c["han"])
    by_words = (F.length("_t") >= 200) & ~(enough(c["hangul"]) | kana | enough(c["han"]) | enough(c["arabic"]))
    d = d.withColumn("_found", F.when(by_words, found_words(F.col("_t"))).otherwise(F.array().cast("array<string>")))
    words = found_function_words(F.col("_t"), F.col("_found"))
    d = d.withColumns({f"_w_{k}": x for k, x in words.items()})
    en, fr, es = F.col("_w_en"), F.col("_w_fr"), F.col("_w_es")
    big, small, rival = F.greatest(en, fr), F.least(en, fr), F.greatest(en, F.col("_w_fr_es"))
    spanish = (es >= 2) & (es >= 2 * rival)
    cases = [
        (F.length("_t") < 200, "en", F.lit(0.0)),
        (enough(c["hangul"]), "ko", share(c["hangul"])),
        (kana, "ja", share(c["kana"] + c["han"])),
        (enough(c["han"]), "zh", share(c["han"])),
        (enough(c["arabic"]), "ar", share(c["arabic"])),
        (spanish, "es", three(1 - rival / es)),
        (big == 0, "en", F.lit(0.0)),
        ((big >= 2 * small) & (fr > en), "fr", three(1 - small / big)),
    ]
    lang, score = F.lit("en"), three(1 - small / big)
    for when, code, x in reversed(cases):
        lang, score = F.when(when, code).otherwise(lang), F.when(when, x).otherwise(score)
    return d.withColumns({"guess": lang, "score": score.cast("double")}).drop("_t", "_beyond", "_found", *[f"_{k}" for k in scripts], *[f"_w_{k}" for k in words])


_WIDE = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, or half where three tenths of them are wide; rounded up."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.ceil(n / F.when(count_of(text, _WIDE) * 10 >= n * 3, 2).otherwise(4))).cast("long")


def redact(text: Column, literals: list[str] = []) -> Column:  # noqa: B006
    """Known secrets, longest first, then the shapes of secrets, become [KEY]."""
    import re

    for x in sorted(filter(None, literals), key=len, reverse=True):
        text = F.regexp_replace(text, re.escape(x), "[KEY]")
    for p in SECRETS:
        text = F.regexp_replace(text, p, "[KEY]")
    return text


def excerpt(body: Column, most: int = 160) -> Column:
    """The first block as plain text, cut with an ellipsis."""
    block = F.split(F.trim(body), r"\n[ \t\r]*\n", 2)[0]
    target = r"\]\([^)]*\)"
    shown = F.regexp_replace(block, rf"(?s)```.*?```|!\[[^\]]*{target}|\[([^\]]*){target}", "$1")  # a link keeps its text
    words = F.filter(F.split(F.translate(shown, "#>*_`~-", ""), r"(?U)\s"), lambda w: w != "")
    plain = F.array_join(words, " ")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


def normal_answer(text: Column) -> Column:
    """For grading: no case, blanks, quotes; wide brackets, commas and stops to ASCII; no closing ()."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+|['\"`]", "")
    return F.regexp_replace(F.translate(x, "（），．", "(),."), r"(\(\))+$", "")


def parse_number(text: Column) -> Column:
    x = F.regexp_replace(text, r"(?U)[,\s%，]", "")
    return F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), x.try_cast("double"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def csv_cell(text: Column) -> Column:
    """Quoted where needed; what a spreadsheet would run as a formula gets a leading quote."""
    x = F.coalesce(text, F.lit(""))
    x = F.when(x.rlike(r"^'*[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(x.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def number_tokens(text: Column) -> Column:
    """Distinct numbers: Eastern digits and group marks made plain, no leading zeros and no trailing ones of a fraction."""
    east = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10)) + "٫"
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), east, "0123456789" * 2 + "."), r"(\d)[,٬](?=\d{3}(?!\d))", "$1")
    found = F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    plain = F.transform(found, lambda n: F.regexp_replace(F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n), r"^0+(?=\d)", ""))
    return F.array_sort(F.array_distinct(plain))


def repeat_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), r"(?U)\s+", " ")))


def garble(text: Column) -> tuple[Column, Column]:
    """(characters that are not blank, those of them that are broken)."""
    bad = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}\x00-\x1F\x7F-\x9F&&[^\s\x85]]"
    return characters_of(text, r"(?U:\S)"), characters_of(text, bad)


def mask(key: Column) -> Column:
    """Head and tail of a key; a short one is all stars."""
    n = F.length(key)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(key, 1, 4), F.lit("…"), F.substring(key, -4, 4)))


def fill_query(template: Column, q: Column) -> Column:
    """URL template with the query percent-encoded (a blank is %20)."""
    return F.replace(template, F.lit("{q}"), F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")))


def safe_link(url: Column) -> Column:
    """ok, or why not: empty, scheme, userinfo, long."""
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty").when(~url.rlike(r"^(?i)https://[^/?#]+"), "scheme").when(url.rlike(r"^(?i)https://[^/?#]*@"), "userinfo").when(F.length(url) > 2048, "long").otherwise("ok")
