"""Keyword search over folded text: query variants, hits with offsets, groups, snippets, headings."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from tessera.functions.text import fold, fold_char, head_key
from tessera.operators.flow import KEEP_BEFORE

SHORTEST, LONGEST, HITS, VARIANTS, AROUND, WORD, REPEATED = 2, 60, 1000, 8, 40, 200, 10
#: Greek letters by name (fixed values), and beginnings of words that may stand with or without a hyphen.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "kappa": "κ"}
PREFIXES = tuple(x for x in KEEP_BEFORE if len(x) >= 3)


def word_char(c: str) -> bool:
    return c.isascii() and c.isalnum() or not c.isascii() and unicodedata.category(c)[0] in "LN"


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return "cjk" if name.startswith(("CJK", "HIRAGANA", "KATAKANA")) or c == "ー" else "hangul" if name.startswith("HANGUL") else ""


@dataclass(frozen=True)
class Query:
    """What to look for: spellings, whether case counts, whether both ends or any end must be a word's."""

    text: str
    variants: tuple[str, ...] = ()
    cased: bool = False
    whole: bool = False
    open: bool = False
    error: str | None = None


def parse(q: str | None) -> Query:
    s = re.sub(r"\s+", " ", q or "").strip()
    one = len(s) == 1 and _script(s) == "cjk"
    if len(s) < SHORTEST and not one:
        return Query(s, error="short")
    if len(s) > LONGEST:
        return Query(s, error="long")
    if re.fullmatch(r"[A-Z0-9]{2,5}", s) and re.search("[A-Z]", s):
        return Query(s, (s,), cased=True, whole=True)
    f = re.sub(r"\s+", " ", "".join(map(fold_char, s))).strip()
    if len(f) < SHORTEST and not one:
        return Query(s, error="short")
    other = GREEK | {v: k for k, v in GREEK.items()}
    spelled = [""]
    for k, token in enumerate(f.split(" ")):
        spelled = [v + " " * bool(k) + x for v in spelled for x in ([token, other[token]] if token in other else [token])][:VARIANTS]
    whole = len(f) <= 3 and not _script(f[-1])
    if not whole:
        for v in list(spelled):
            for p in PREFIXES:
                if v.startswith(p + " ") and len(v) > len(p) + 3 and " " not in v[len(p) + 1 :]:
                    spelled.append(p + v[len(p) + 1 :])
                elif v.startswith(p) and len(v) >= len(p) + 3 and " " not in v:
                    spelled.append(p + " " + v[len(p) :])
    return Query(s, tuple(dict.fromkeys(spelled)), whole=whole, open=_script(f[0]) == "cjk")


def find(hay: str, q: Query) -> list[tuple[int, int]]:
    """(offset, length) of every hit; the longest spelling at an offset counts."""
    best: dict[int, int] = {}
    for v in q.variants:
        i = hay.find(v)
        while i >= 0:
            e = i + len(v)
            if (q.open or not i or not word_char(hay[i - 1])) and (not q.whole or e == len(hay) or not word_char(hay[e])):
                best[i] = max(best.get(i, 0), len(v))
            i = hay.find(v, i + 1)
    return sorted(best.items())


def hits(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", limit: int = HITS) -> DataFrame:
    """key, at, len, n: the first ``limit`` hits of each text, and how many there are. A query that is no good finds none."""
    found = counted(docs, query, key, text)
    return found.select(key, "n", F.explode(F.slice("h", 1, limit)).alias("x")).select(key, "x.at", "x.len", "n")


def counted(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, h (array of at, len): one row for each text that has a hit."""
    q = parse(query)

    @pandas_udf(ArrayType(IntegerType()))
    def look(x: pd.Series) -> pd.Series:  # at, len, at, len: a batch holds eight bytes for a hit, and no object
        return pd.Series([np.array(find(t, q) if t else [], np.int32).ravel() for t in x], dtype=object)

    hay = F.col(text) if q.cased else fold(F.col(text))
    rows = docs.select(key, hay.alias("hay"))
    if q.error:
        rows = rows.limit(0)
    else:  # the JVM drops texts that hold no spelling before any goes to Python
        some = F.lit(False)
        for v in q.variants:
            some = some | F.col("hay").contains(v)
        rows = rows.where(some)
    found = rows.select(key, look("hay").alias("_f")).where(F.size("_f") > 0)
    h = F.transform(F.sequence(F.lit(0), F.size("_f") - 2, F.lit(2)), lambda i: F.struct(F.get("_f", i).alias("at"), F.get("_f", i + 1).alias("len")))
    return found.select(key, (F.size("_f") / 2).cast("int").alias("n"), h.alias("h"))


def groups(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, first, truncated: hits of a text as one row."""
    return found.groupBy(key).agg(F.max("n").alias("n"), F.min("at").alias("first"), (F.max("n") > HITS).alias("truncated"))


def snippet(text: Column, at: Column, length: Column, around: int = AROUND) -> Column:
    """The hit with some text about it, inside its line and widened to whole words. Only as much of the text as may be
    shown is cut out: WORD characters are room enough for the word that an end falls into."""
    reach = around + WORD
    before = F.substring_index(text.substr(F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))), "\n", -1)
    after = F.substring_index(text.substr(at + length + 1, F.lit(reach)), "\n", 1)
    word = r"[\p{L}\p{N}]"
    left = F.when(F.length(before) <= around, before).otherwise(F.regexp_extract(before, rf"{word}*.{{{around}}}$", 0))
    right = F.when(F.length(after) <= around, after).otherwise(F.regexp_extract(after, rf"^.{{{around}}}{word}*", 0))
    return F.concat(left, F.lit("["), text.substr(at + 1, length), F.lit("]"), right)


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 80) -> DataFrame:
    """key, line, title, k, repeated: lines that look like headings, and whether one is repeated in its document."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "title"))
    rows = rows.where((F.length("title").between(3, most)) & ~F.col("title").rlike(r"[.!?:;,]\s*$")).withColumn("k", head_key(F.col("title"))).where("k <> ''")
    w = Window.partitionBy(key, "k")
    return rows.withColumn("repeated", F.count("*").over(w) >= REPEATED)


def line_ranges(found: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, at, seq, lo, hi: hits (key, at, len) as stretches of the lines (key, seq, base, text) that they touch."""
    j = found.join(lines.select(key, "seq", "base", F.length("text").alias("_n")), key)
    a, b = F.col("at"), F.col("at") + F.col("len")
    j = j.where((F.col("base") < b) & (F.col("base") + F.col("_n") > a))
    return j.select(key, "at", "seq", (F.greatest(a, "base") - F.col("base")).alias("lo"), (F.least(b, F.col("base") + F.col("_n")) - F.col("base")).alias("hi"))


#: Passages that every task is sent (by their number); short ones in as many rounds as they take.
FEW = 10_000


def meeting(docs: DataFrame, passages: DataFrame, key: str, item: str, text: str = "text", passage: str = "passage") -> DataFrame:
    """All columns of texts (key, text) and passages (item, passage), for each two of which the text may contain the passage.

    A passage's words but the first and the last stand whole in any text that holds it, so each passage is looked up by some
    of those: the two neighbours of which the first is longest, or the only one. Of a text only words count that are as long
    as the shortest that is looked up. They meet by their hashes, in one pass. Up to FEW passages every task has them all
    and texts do not move; beyond, words are shuffled alone and only texts that meet a passage follow. Passages of one or
    two words have no inner word: they meet every text, FEW at a time.
    """
    # a pair begins at each word, so pairs overlap: they are what lies ahead of a place
    every = lambda c, n: F.regexp_extract_all(c, F.lit(rf"(?<!\S)(?=(\S{{{n},}}\s+\S+))"), F.lit(1))
    word = lambda c, n: F.regexp_extract_all(c, F.lit(rf"(?<!\S)\S{{{n},}}"), F.lit(0))
    p = passages.withColumn("_w", word(passage, 1)).withColumn("_p", every(passage, 1))
    p = p.withColumn("_w", F.when(F.size("_w") == 3, F.get("_w", F.lit(1)))).withColumn("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 2, F.lit(0))))
    p = p.withColumn("_p", F.array_max(F.transform("_p", lambda x: F.struct(F.length(F.regexp_extract(x, r"^\S+", 0)).alias("first"), F.length(x).alias("n"), x.alias("pair")))))
    p = p.withColumn("_k", F.xxhash64(F.coalesce("_w", "_p.pair"))).withColumn("_k", F.when(F.coalesce("_w", "_p.pair").isNotNull(), F.col("_k")))
    known, short = p.where("_k IS NOT NULL").drop("_w", "_p"), p.where("_k IS NULL").drop("_w", "_p", "_k")
    n_known, n_short, one, two = p.agg(F.count("_k"), F.count_if(F.col("_k").isNull()), F.min(F.length("_w")), F.min("_p.first")).first()
    found = docs.limit(0).join(passages.limit(0))
    if n_known:
        own = F.concat(*[word(text, one)] * (one is not None), *[every(text, two)] * (two is not None))
        grams = F.explode(F.array_distinct(F.transform(own, lambda x: F.xxhash64(x)))).alias("_k")
        if n_known <= FEW:
            near = docs.select(*docs.columns, grams).join(F.broadcast(known), "_k").drop("_k")
        else:
            near = docs.select(key, grams).join(known, "_k").drop("_k").distinct().join(docs, key)
        found = found.unionByName(near)
    if n_short:
        rounds = -(-2 * n_short // FEW) if n_short > FEW else 1
        dealt = short.withColumn("_r", F.pmod(F.xxhash64(item, passage), F.lit(rounds)))
        for r in range(rounds):
            own = F.broadcast(dealt.where(F.col("_r") == r).drop("_r"))  # some FEW / 2 rows, or FEW in one round
            found = found.unionByName(docs.crossJoin(own))
    return found


def containing(docs: DataFrame, passages: DataFrame, key: str, item: str) -> DataFrame:
    """key, item: texts (key, text) that contain a passage (item, passage) as it stands."""
    near = meeting(docs.select(key, "text"), passages.select(item, "passage").distinct(), key, item)
    return near.where("contains(text, passage)").select(key, item).distinct()
