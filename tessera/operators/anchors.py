"""Notes' anchors: quotes with context, found again in texts that have changed, and written back where they moved.

An anchor names its paragraph by a hash. Anchors and paragraphs meet by that hash in an equality join; only anchors that
find nothing so are sought in their document's paragraphs that hold the quote, then in those that hold it without case,
accents, blanks and hyphens, and at last across the ends of paragraphs. The JVM drops paragraphs that cannot hold a quote;
places and their contexts are compared in Arrow batches of what is left.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from tessera.functions.text import fold, fold_char
from tessera.session import stored

CONTEXT, QUOTE = 32, 400
#: A loose quote shorter than this (without blanks) is only taken if so much of its context agrees.
SHORT, AGREES = 8, 8
_GAPS = r"(?U)[\s­‐‑-]+"


def anchor(text: Column, start: Column, end: Column) -> Column:
    """(exact, prefix, suffix, at) of a selection, trimmed and cut to QUOTE characters."""
    raw = text.substr(start + 1, F.least(end - start, F.lit(QUOTE)))
    exact = F.trim(raw)
    at = start + F.length(raw) - F.length(F.ltrim(raw))
    return F.struct(exact.alias("exact"), text.substr(F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))).alias("prefix"), text.substr(at + F.length(exact) + 1, F.lit(CONTEXT)).alias("suffix"), at.alias("at"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, para, base, text, hash: lines of each text, where they begin in it, and a hash of what they say."""
    lines = F.split(text, "\n")
    sizes = F.transform(lines, lambda x: F.length(x) + 1)
    bases = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = docs.select(key, F.posexplode(F.arrays_zip(lines.alias("text"), bases.alias("base"))).alias("para", "x")).where("x.text IS NOT NULL")
    return rows.select(key, "para", "x.base", "x.text", paragraph_hash(F.col("x.text")).alias("hash"))


def paragraph_hash(text: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " ")))  # a blank alone stays as it is


def squeezed(text: Column) -> Column:
    """Without case, accents, blanks and hyphens. Plain ASCII has no accents and needs no table."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.regexp_replace(F.lower(text), r"[\s-]+", "")).otherwise(F.regexp_replace(fold(text), _GAPS, ""))


@cache
def _squeezed_char(c: str) -> str:
    return "" if c.isspace() or c in "­‐‑-" else fold_char(c)


def _loose(text: str) -> tuple[str, list[int]]:
    """As squeezed(), and where each character came from."""
    chars = [_squeezed_char(c) for c in text]
    return "".join(chars), [i for i, c in enumerate(chars) if c]


def _places(text: str, part: str) -> list[int]:
    """Where a part begins in a text, those that overlap too."""
    found, i = [], text.find(part)
    while i >= 0:
        found.append(i)
        i = text.find(part, i + 1)
    return found


def _common(a: str, b: str) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def spots(text: str, exact: str, prefix: str, suffix: str, as_is: bool) -> list[tuple[int, int, int]]:
    """(offset, length, score) of every place of a quote in a text; the score is how much of the context agrees."""
    if as_is:
        found = [(i, i + len(exact)) for i in _places(text, exact)]
        clean = lambda x: x
    else:
        hay, where = _loose(text)
        needle = _loose(exact)[0]
        found = [(where[i], where[i + len(needle) - 1] + 1) for i in _places(hay, needle)] if needle else []
        clean = lambda x: _loose(x)[0]
    p, s = clean(prefix)[::-1], clean(suffix)
    return [(a, b - a, _common(clean(text[max(0, a - 2 * CONTEXT) : a])[::-1], p) + _common(clean(text[b : b + 2 * CONTEXT]), s)) for a, b in found]


_SPOT = pa.struct({"at": pa.int32(), "len": pa.int32(), "score": pa.int32()})


def _udf(as_is: bool):
    @arrow_udf("array<struct<at: int, len: int, score: int>>")
    def places(text: pa.Array, exact: pa.Array, prefix: pa.Array, suffix: pa.Array) -> pa.Array:
        found = [spots(t, e, p or "", q or "", as_is) for t, e, p, q in zip(*(x.to_pylist() for x in (text, exact, prefix, suffix)))]
        ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
        columns = zip(*chain.from_iterable(found)) if ends[-1].as_py() else ((), (), ())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in columns], fields=list(_SPOT)))

    return places


def _sought(pairs: DataFrame, how: str) -> DataFrame:
    """_id, found: of pairs (anchor, para, base, text) the place whose context agrees most; of several the nearest to where it
    was, and then ``tie`` is true."""
    found = pairs.withColumn("x", F.explode(_udf(how in ("para", "page"))("text", "exact", "prefix", "suffix")))
    if how not in ("para", "page"):
        small = F.length(squeezed(F.col("exact"))) < SHORT
        found = found.where(~small | (F.col("x.score") >= AGREES))
    found = found.withColumn("place", F.col("base") + F.col("x.at"))
    w = Window.partitionBy("_id")
    found = found.withColumn("_best", F.max("x.score").over(w)).where(F.col("x.score") == F.col("_best"))
    near = F.struct(F.abs(F.col("place") - F.col("at")), "place")
    place = F.struct(F.col("place").alias("at"), F.col("x.len").alias("len"), F.col("x.score").alias("score"), F.lit(how).alias("how"))
    out = found.groupBy("_id").agg(F.min_by(place, near).alias("p"), (F.min("place") < F.max("place")).alias("tie"))
    return out.select("_id", F.struct("p.at", "p.len", "p.score", "p.how", "tie").alias("found"))


def resolve(anchors: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """anchors (key, exact, prefix, suffix, at, and hash if they name a paragraph) with ``found``: (at, len, score, how, tie) of
    each in docs (key, text) now, null if nowhere. How: ``para``, as it is in a paragraph of the same hash; ``page``, as it is
    in any paragraph; ``fuzzy``, without case, accents, blanks and hyphens; ``across``, likewise over paragraphs' ends.

    Null or empty quotes and null texts find nothing; rows of one anchor each are found. A quote that holds line ends is
    sought across paragraphs."""
    given = stored(anchors.withColumn("_id", F.monotonically_increasing_id()))
    hash_ = F.col("hash") if "hash" in anchors.columns else F.lit(None).cast("string")
    left = given.where(F.length("exact") > 0).select("_id", key, "exact", "prefix", "suffix", "at", hash_.alias("hash"))
    paras = stored(paragraphs(docs, key))
    p = paras.select(key, "para", "base", "text")
    whole = docs.select(key, F.lit(0).alias("para"), F.lit(0).alias("base"), "text")

    def loosely(x: DataFrame, texts: DataFrame) -> DataFrame:
        x = x.withColumn("_l", squeezed(F.col("exact"))).where("_l <> ''")
        texts = texts.join(x.select(key), key, "left_semi").withColumn("_t", squeezed(F.col("text"))).repartition(key)  # once a text, not once a pair
        return x.join(texts, key).where("contains(_t, _l)").drop("_l", "_t")

    steps = [
        ("para", lambda x: x.where("hash IS NOT NULL").join(paras, [key, "hash"]).where("contains(text, exact)")),
        ("page", lambda x: x.join(p, key).where("contains(text, exact)")),
        ("fuzzy", lambda x: loosely(x, p)),
        ("across", lambda x: loosely(x, whole)),
    ]
    found = None
    for how, pairs in steps:
        step = stored(left.join(_sought(pairs(left), how), "_id", "left"))
        own = step.where("found IS NOT NULL").select("_id", "found")
        found = own if found is None else found.unionByName(own)
        left = step.where("found IS NULL").drop("found")
        if left.isEmpty():
            break
    return given.join(found, "_id", "left").drop("_id")


def write_back(resolved: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Anchors as they should be stored: those found at another place or in another form take the text, context, place and
    paragraph hash of where they are now; those that are not found, and those between which a tie had to choose, stay as
    they are. ``changed`` tells which were written anew."""
    paras = paragraphs(docs, key).select(key, F.col("base").alias("_base"), F.col("hash").alias("_hash"), F.length("text").alias("_n"))
    moves = resolved.withColumn("_id", F.monotonically_increasing_id())
    moved = F.col("found").isNotNull() & ~F.col("found.tie") & ((F.col("found.at") != F.col("at")) | (F.col("found.how") != "para"))
    j = moves.where(moved).join(docs.select(key, F.col("text").alias("_text")), key)
    now = anchor(F.col("_text"), F.col("found.at"), F.col("found.at") + F.col("found.len"))
    j = j.withColumn("_now", now).join(paras, [key]).where((F.col("_base") <= F.col("found.at")) & (F.col("found.at") <= F.col("_base") + F.col("_n")))
    old = ["exact", "prefix", "suffix", "at", "hash"]
    changed = j.select(*[F.col(c) for c in resolved.columns if c not in old and c != "found"], *(F.col(f"_now.{c}") for c in old[:-1]), F.col("_hash").alias("hash"), F.lit(True).alias("changed"))
    kept = moves.where(~F.coalesce(moved, F.lit(False))).select(*[c for c in resolved.columns if c not in old and c != "found"], *old, F.lit(False).alias("changed"))
    return kept.unionByName(changed)
