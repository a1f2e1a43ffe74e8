"""Checks of what a model answers against what it was given: numbers, lengths, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import let, number_tokens
from tessera.operators.vocab import POS, one_line

#: Characters from which lengths are compared, how many times they may differ, failures of a chunk beyond one in so many;
#: longest translation and gloss; context about a sentence; sentences and characters of an explanation.
SHORT, TIMES, FAILED_OF, LONGEST, GLOSS, CONTEXT, SENTENCES, CHARS = 20, 5, 5, 200, 300, 1500, 3, 400
_EAST = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10))
_RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻"
_NUMBER = rf"(?:[0-9]|[{_RAISED}])(?:[0-9{_RAISED}]|[.,](?=[0-9])|[\u00A0\u2009\u202F](?=[0-9]{{3}}(?![0-9]))|\^[-+−]?(?=[0-9]))*"
_SIGN = r"(?:(?<!\p{L})[-+<>~−–—±≤≥≈～〜]|[<>~±≤≥≈～〜])"
_CHUNK = rf"(?:{_SIGN} ?(?:[-+−–±] ?)?)?{_NUMBER}(?: ?[-:/^x~×–—−～〜] ?{_NUMBER})*(?: ?[%‰°])?"


def _plain(text: Column) -> Column:
    """Eastern digits and marks as plain ones, one character for one; no invisible ones."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Cf}", ""), _EAST + "٪٫٬", "0123456789" * 2 + "%.,")


def chunk_key(chunk: Column) -> Column:
    """A number as it is compared: no blanks, one dash, one wave, one times sign, raised digits after ^, no thousands marks."""
    t = F.regexp_replace(_plain(chunk), r"(?U)[\s\u00A0\u2009\u202F]", "")
    t = F.regexp_replace(t, rf"([{_RAISED}]+)", "^$1")
    t = F.translate(t, _RAISED + "‐‑‒–—―−≈～〜x", "0123456789-" + "-" * 7 + "~~~×")
    return F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def number_chunks(text: Column) -> Column:
    """Numeric expressions of a text (ranges, ratios, powers, signs, percent) as they are compared."""
    return F.transform(F.regexp_extract_all(_plain(text), F.lit(f"({_CHUNK})"), F.lit(1)), chunk_key)


def number_units(text: Column) -> Column:
    """array(k, u): numeric expressions with the unit that follows, in small letters; empty where none does or a percent
    sign is the unit, null where the number is a name's part, as in CD4."""
    unit = r"(?: ?(/?\p{L}[\p{L}\p{M}\p{N}/µ]*))?"
    full = F.regexp_extract_all(_plain(text), F.lit(rf"((?:\p{{L}}-?(?=[0-9]))?{_CHUNK}{unit})"), F.lit(1))

    def split(x: Column) -> Column:
        name = x.rlike(r"^\p{L}-?[0-9]")
        body = F.regexp_replace(x, r"^\p{L}-?(?=[0-9])", "")
        number = F.regexp_extract(body, f"^({_CHUNK})", 1)
        u = F.lower(F.trim(F.substring(body, F.length(number) + 1, F.length(body))))
        return F.struct(chunk_key(number).alias("k"), F.when(~name, F.when(number.rlike("[%％]$"), "").otherwise(u)).alias("u"))

    return F.transform(full, split)


def translations(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """key, i, state, reason, failed: asked segments (key, i, text) with their answers (key, seq, i, t). An answer is missing,
    of a length that cannot be (ratio), or without any number of its text (digits); the first answer to a segment counts;
    failed tells that more than a fifth of the chunk went wrong, as when answers slipped by one."""
    first = answered.groupBy(key, "i").agg(F.min_by(F.trim("t"), "seq").alias("t"))
    j = asked.join(first, [key, "i"], "left")
    a, b = F.length("text"), F.length("t")
    ratio = (b == 0) | ((a >= SHORT) & ((b * TIMES < a) | (b > a * TIMES)))
    want = number_tokens(F.col("text"))
    digits = (F.size(want) > 0) & ~F.arrays_overlap(want, number_tokens(F.col("t")))
    reason = F.when(F.col("t").isNull(), "missing").when(ratio, "ratio").when(digits, "digits")
    j = j.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "ok").when(F.col("reason") == "missing", "missing").otherwise("failed"))
    w = Window.partitionBy(key)
    return j.withColumn("failed", F.count_if(F.col("state") == "failed").over(w) * FAILED_OF > F.count("*").over(w)).select(key, "i", "state", "reason", "failed")


def terms(asked: DataFrame, answered: DataFrame, key: str, script: str | None = None) -> DataFrame:
    """key, i, state, reason, translation, pos, gloss: asked terms (key, i) with the first answer (key, seq, i, translation, pos,
    gloss) to each: empty, long, or not in the target's script (a Unicode script's name) fails."""
    first = answered.groupBy(key, "i").agg(F.min_by(F.struct("translation", "pos", "gloss"), "seq").alias("x"))
    j = asked.join(first, [key, "i"], "left")
    t = one_line(F.col("x.translation"))
    reason = F.when(F.col("x").isNull(), "missing").when(t == "", "empty").when(F.length(t) > LONGEST, "long")
    if script:
        reason = reason.when(~t.rlike(rf"\p{{Is{script}}}"), "lang")
    pos = F.lower(F.trim("x.pos"))
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return j.select(key, "i", F.when(ok, "ok").when(F.col("reason") == "missing", "missing").otherwise("failed").alias("state"), "reason", F.when(ok, t).alias("translation"), F.when(ok, F.when(pos.isin(*POS), pos).otherwise("other")).alias("pos"), F.when(ok, F.substring(one_line(F.col("x.gloss")), 1, GLOSS)).alias("gloss"))


def simple_sentences(text: Column) -> Column:
    """Sentences cut after any closing mark that a blank follows, or after a wide one."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)([.!?…。！？]+[\"”’')\]]*)(?=\s|$)|([。！？][”’』」）]*)", "$1$2\x01")
    return F.filter(F.transform(F.split(t, "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def explanation(text: Column, source: Column) -> Column:
    """The first sentences of an explanation that name no number the source lacks, so many sentences and characters at most."""
    ok = let(number_tokens(source), lambda known: F.filter(simple_sentences(text), lambda x: F.size(F.array_except(number_tokens(x), known)) == 0))
    first = F.slice(ok, 1, SENTENCES)
    joined = F.aggregate(first, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.length(acc) + 1 + F.length(x) > CHARS, acc).otherwise(F.concat_ws(" ", acc, x)))
    cut = lambda x: F.when(F.length(x) > CHARS, F.regexp_replace(F.substring(x, 1, CHARS), r"\s+\S*$", "")).otherwise(x)
    return let(let(joined, cut), lambda x: F.when(x != "", x))


def context(sentence: Column, para: Column, most: int = CONTEXT) -> Column:
    """A stretch of a paragraph about a sentence, whole words only; all of it if it is short."""

    def place(x: Column) -> Column:
        p, s, n = x["p"], x["s"], F.length(x["p"])
        at = F.call_function("locate", s, p)
        middle = lambda a: F.when((a > 0) & (s != ""), a - 1 + F.length(s) / 2).otherwise(F.lit(0.0))
        start = lambda a: F.greatest(F.lit(0), F.least(n - most, F.floor(middle(a) - most / 2 + 0.5).cast("int"))).cast("int")
        return F.when(n <= most, p).otherwise(let(let(at, start), lambda k: stretch(p, n, k)))

    def stretch(p: Column, n: Column, start: Column) -> Column:
        before, after = p.substr(start, F.lit(1)), p.substr(start + most + 1, F.lit(1))
        cut = p.substr(start + 1, F.lit(most))
        cut = F.when((start > 0) & (before != " "), F.regexp_replace(cut, "^[^ ]+", "")).otherwise(cut)
        return F.trim(F.when((start + most < n) & (after != " "), F.regexp_replace(cut, "[^ ]+$", "")).otherwise(cut))

    return let(F.struct(one_line(para).alias("p"), one_line(sentence).alias("s")), place)
