"""Forms of a text in which quotes are sought, with the place in the text that each of their characters comes from.

The normal form takes compatibility characters apart, makes quotes and dashes plain and blanks single, and leaves out soft
hyphens and hyphens at line ends inside a word. The loose form leaves out marks besides, but for those that belong to a
number and ? and !. One character may become several (a ligature, a fraction) or none; each keeps where it came from, so
what is found in a form can be shown in the text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_PLAIN = {**dict.fromkeys("‘’‚‛′", "'"), **dict.fromkeys("“”„‟″«»", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), "­": ""}
_BROKEN = re.compile(r"[-‐](?<=[^\W\d_].)[^\S\n]*\n\s*(?=[^\W\d_])")
_WIDE = re.compile("[\U00010000-\U0010ffff]")


@dataclass
class Form:
    """The characters of a form, and of each the beginning and the end of its source."""

    text: str
    starts: array
    ends: array


@lru_cache(1 << 16)
def _pieces(c: str) -> str:
    if c in _PLAIN:
        return _PLAIN[c]
    return " " if c.isspace() else unicodedata.normalize("NFKC", c)


class _Table(dict):
    """What each character becomes, found when it is first met: for str.translate."""

    def __missing__(self, k: int) -> str:
        self[k] = p = _pieces(chr(k))
        return p


_TO = _Table()


def _single(text: str) -> str:
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def normal_text(text: str) -> str:
    """The text of normal(), without places: many times as fast."""
    if "\n" in text:
        text = _BROKEN.sub(lambda m: "" if m.string[m.end()].islower() else m[0], text)
    to = {c: p for c in set(text) if (p := _TO[ord(c)]) != c}
    if len(to) > 16 or any(c in to for p in to.values() for c in p):
        return _single(text.translate(_TO))
    for c, p in to.items():  # a few characters, none of which another becomes
        text = text.replace(c, p)
    return _single(text)


@lru_cache(2)
def _dropped(last: int) -> re.Pattern:
    """The marks up to a character that loose() leaves out."""

    def some(have) -> str:
        own, runs = [k for k in range(last + 1) if have(chr(k))], []
        for k in own:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs) + "]"

    m, d = some(lambda c: unicodedata.category(c)[0] in "PS" and c not in "?!"), some(str.isdigit)
    return re.compile(rf"{m}(?:(?<!{d}.)(?!{d})|(?<={d}.)(?<![%‰])(?!{d})|(?<!{d}.)(?<![+\-±.])(?={d}))", re.S)


def loose_text(normal: str) -> str:
    """The text of loose(), out of that of normal()."""
    return _single(_dropped(sys.maxunicode if _WIDE.search(normal) else 0xFFFF).sub("", normal))


def normal(text: str, most: int | None = None) -> Form:
    """The form, or its beginning of so many characters at least."""
    out, starts, ends = [], array("i"), array("i")
    skip = {i for m in _BROKEN.finditer(text) for i in range(*m.span()) if text[m.end()].islower()}
    for i, c in enumerate(text):
        if most is not None and len(out) > most:
            break
        for p in () if i in skip else _pieces(c):
            if p == " " and (not out or out[-1] == " "):
                continue
            out.append(p)
            starts.append(i)
            ends.append(i + 1)
    if out and out[-1] == " ":
        out.pop(), starts.pop(), ends.pop()
    return Form("".join(out), starts, ends)


def loose(form: Form) -> Form:
    t, keep = form.text, []
    for i, c in enumerate(t):
        before, after = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
        number = before.isdigit() and (after.isdigit() or c in "%‰") or after.isdigit() and not before.isdigit() and c in "+-±."
        if c == " ":
            if keep and t[keep[-1]] != " ":
                keep.append(i)
        elif number or c in "?!" or unicodedata.category(c)[0] not in "PS":
            keep.append(i)
    if keep and t[keep[-1]] == " ":
        keep.pop()
    return Form("".join(t[i] for i in keep), array("i", [form.starts[i] for i in keep]), array("i", [form.ends[i] for i in keep]))


def _inside(a: str, b: str) -> bool:
    """Do two neighbours belong to one word or number?"""
    kind = lambda c: unicodedata.category(c)[0]
    return bool(a and b) and kind(a) in "LNM" and kind(b) in "LNM"


def place(text: str | None, quote: str | None) -> tuple[str | None, int | None, int | None]:
    """(how, start, end) of the first place at which the text holds the quote at whole words: exact in the normal forms, else
    loose in the loose ones; how is ``inside`` where it only stands inside words, null where it does not stand."""
    if not text or not quote:
        return None, None, None
    t, wanted = normal_text(text), normal_text(quote)
    cut = False
    for how in ("exact", "loose"):
        if how == "loose":
            t, wanted = loose_text(t), loose_text(wanted)
        n = len(wanted)
        at = t.find(wanted) if n else -1
        while at >= 0:
            if not _inside(t[at - 1 : at] if at else "", t[at]) and not _inside(t[at + n - 1], t[at + n : at + n + 1]):
                form = normal(text, at + n) if how == "exact" else loose(normal(text))  # places are found only where a quote stands
                return how, form.starts[at], form.ends[at + n - 1]
            cut = True
            at = t.find(wanted, at + 1)
    return ("inside" if cut else None), None, None


_FORMS = StructType([StructField("normal", StringType()), StructField("loose", StringType())])
_PLACE = StructType([StructField("how", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


@pandas_udf(_FORMS)
def forms(text: pd.Series) -> pd.DataFrame:
    made = [(n := normal_text(t or ""), loose_text(n)) for t in text]
    return pd.DataFrame({"normal": [a for a, _ in made], "loose": [b for _, b in made]}, dtype=object)


@pandas_udf(_PLACE)
def quote_place(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    got = [place(t, q) for t, q in zip(text, quote)]
    return pd.DataFrame({"how": pd.Series([g[0] for g in got], dtype=object), "start": pd.array([g[1] for g in got], "Int32"), "end": pd.array([g[2] for g in got], "Int32")})
