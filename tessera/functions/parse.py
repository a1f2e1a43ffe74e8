"""Sentences as column expressions; parsers that need more than patterns, Arrow-batched: broken JSON, evidence quotes."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Words after which a stop ends no sentence, and marks of list items (fixed values).
ABBREVIATIONS = frozenset(
    "e.g. i.e. vs. etc. cf. ca. approx. no. nos. al. fig. figs. tbl. chap. chaps. sec. ed. eds. vol. vols. p. pp. dr. mr. mrs. ms. prof. st. jr. sr. inc. ltd. min. max. wt. mg. kg.".split()
)
BULLETS = "•▪◦‣●■▸►"
#: What a sentence may begin with, by language; other languages go by the first.
STARTS = {"en": r"A-Z0-9(\[«\"“'", "fr": r"\p{Lu}0-9(\[«\"“'", "ko": r"\p{Lu}\p{IsHangul}0-9(\[«\"“'", "es": r"\p{Lu}0-9(\[«\"“'"}
_CUT = "\x01"


def sentences(text: Column, lang: Column) -> Column:
    """Sentences of a text: cut after a stop that ends one (no abbreviation, no initial), where the next word looks like a
    beginning; before a list item's mark; after an identifier in brackets, where a sentence, a bracket or an item begins."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    short = "|".join(re.escape(x) for x in sorted(ABBREVIATIONS))

    # a blank and what follows it are looked at first, what stands before only where these fit
    def cut(lang: str) -> Column:
        start = rf" (?=[{STARTS[lang]}]" + (r"|[¿¡](?!\p{Ll}))" if lang == "es" else ")")
        stop = rf"{start}(?<=[.!?…\"”')\]] )(?<=[.!?…][\"”')\]]{{0,6}} )(?<!(?:^|[ {_CUT}])(?i:{short}) )(?<!(?:^|[ (\[«\"'{_CUT}])[A-Z]\. )"
        named = rf" (?=[{STARTS[lang]}\[{BULLETS}{'¿¡' if lang == 'es' else ''}])(?<=\][.;,]? )(?<=\[ ?(?i:PMC?ID|DOI)\b[^\[\]]{{0,80}}\][.;,]? )"
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf" (?=[{BULLETS}] )(?<=[^ ] )", _CUT), named, _CUT), stop, _CUT)

    code = F.coalesce(lang, F.lit("en"))
    marked = F.when(code == "fr", cut("fr")).when(code == "es", cut("es")).when(code == "ko", cut("ko")).otherwise(cut("en"))
    return F.filter(F.transform(F.split(marked, _CUT), lambda x: F.trim(x)), lambda x: x != "")


def repair_json(raw: str | None) -> tuple[object, list[str]]:
    """A value out of sloppy JSON, and what had to be done: fence, slice, quotes, comments, commas, closed, failed."""
    t, done = (raw or "").strip(), []

    def attempt(x: str):
        try:
            return True, json.loads(x)
        except ValueError:
            return False, None

    ok, v = attempt(t)
    if ok:
        return v, done
    if m := re.search(r"```(?:\w+)?\s*([\s\S]*?)(?:```|$)", t):
        t = m[1].strip()
        done.append("fence")
    if m := re.search(r"[{\[]", t):
        if m.start():
            t = t[m.start() :]
            done.append("slice")
    ok, v = attempt(t)
    if ok:
        return v, done
    out, stack, text, escape, i = [], [], False, False, 0
    marks: list[tuple[int, int, str]] = []  # what is whole up to here: (parts of out, the open bracket's place or -1, what closes it)
    good = 0  # where the last complete value ends
    while i < len(t):
        c = t[i]
        if text:
            out.append(c)
            if escape:
                escape = False
            elif c == "\\":
                escape = True
            elif c == '"':
                text = False
        elif c in "“”":
            c = '"'
            end = next((j for j in range(i + 1, len(t)) if t[j] in '“”"'), len(t))
            out.append(json.dumps(t[i + 1 : end], ensure_ascii=False))
            done.append("quotes")
            i = end
        elif c == '"':
            text = True
            out.append(c)
        elif t.startswith("//", i):
            i = (t.find("\n", i) + 1 or len(t) + 1) - 1
            done.append("comments")
        elif t.startswith("/*", i):
            i = (t.find("*/", i) + 2 if "*/" in t[i:] else len(t)) - 1
            done.append("comments")
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
            marks.append((len(out), len(out) - 1, "".join(reversed(stack))))
        elif c in "}]":
            while out and out[-1].isspace():
                out.pop()
            if out and out[-1] == ",":
                out.pop()
                done.append("commas")
            if stack:
                stack.pop()
            out.append(c)
            if not stack:
                good = len(out)
                break
        else:
            if c == "," and stack:
                marks.append((len(out), -1, "".join(reversed(stack))))
            out.append(c)
        i += 1
    if good:
        ok, v = attempt("".join(out[:good]))
        return (v, sorted(set(done))) if ok else (None, [*sorted(set(done)), "failed"])
    done = sorted(set(done))
    x = "".join(out)
    ok, v = attempt(re.sub(r"[,:]\s*$", "", (x[:-1] if escape else x) + '"' * text) + "".join(reversed(stack)))
    if ok:
        return v, [*done, "closed"]
    # the longest beginning that can be closed: if one can, so can every shorter one, so halving finds it
    lo, hi, best = 0, len(marks), None
    while lo < hi:
        mid = (lo + hi) // 2
        ok, v = attempt("".join(out[: marks[mid][0]]) + marks[mid][2])
        if ok:
            lo, best = mid + 1, (mid, v)
        else:
            hi = mid
    if best is None:
        return None, [*done, "failed"]
    at, opened, closers = marks[best[0]]
    if opened > 0:  # nothing stands in the last bracket: rather without it
        ok, v = attempt(re.sub(r",\s*$", "", "".join(out[:opened])) + closers[1:])
        if ok:
            return v, [*done, "closed"]
    return (None, [*done, "failed"]) if opened == 0 else (best[1], [*done, "closed"])


@pandas_udf(StructType([StructField("value", StringType()), StructField("repairs", ArrayType(StringType()))]))
def repaired_json(text: pd.Series) -> pd.DataFrame:
    got = [repair_json(t) for t in text]
    return pd.DataFrame({"value": [None if "failed" in r else json.dumps(v, ensure_ascii=False) for v, r in got], "repairs": [r for _, r in got]})


@lru_cache(256)  # the quotes of one text come one after another, and so do those of many texts
def exact_form(text: str) -> str:
    """Compatibility forms, plain quotes and dashes, single blanks, no soft hyphens."""
    t = unicodedata.normalize("NFKC", text.replace("­", ""))
    t = re.sub("[‘’‚‛′]", "'", re.sub("[“”„‟″«»]", '"', re.sub("[‐-―−]", "-", t)))
    return re.sub(r"\s+", " ", t).strip()


@lru_cache(256)
def loose_form(text: str) -> str:
    """The exact form without marks, but for those of numbers and ? and !."""
    t = exact_form(text)
    out = []
    for i, c in enumerate(t):
        p, n = t[i - 1 : i], t[i + 1 : i + 2]
        keep = p.isdigit() and n.isdigit() or c in "-+±." and n.isdigit() and not p.isdigit() or c in "%‰" and p.isdigit() or c in "?!"
        if keep or not unicodedata.category(c)[0] in "PS":
            out.append(c)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def holds(text: str, quote: str) -> str | None:
    """exact or loose if the text holds the quote at whole words, else null."""
    for how, form in (("exact", exact_form), ("loose", loose_form)):
        q = form(quote)
        if q and re.search(r"(?<!\w)" * q[0].isalnum() + re.escape(q) + r"(?!\w)" * q[-1].isalnum(), form(text)):
            return how
    return None


@pandas_udf(StringType())
def evidence(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([holds(t, q) if t and q else None for t, q in zip(text, quote)])
