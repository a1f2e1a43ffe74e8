"""Ingesting long documents page by page: what to do next, what is done, what is cached, which file is which."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tessera.operators.flow import KEEP_AFTER, KEEP_BEFORE

#: Version of the page format; a file up to FULL bytes is hashed whole, a larger one at both ends and at SAMPLES places.
ALGO, FULL, EDGE, SAMPLES, PIECE = 1, 8 << 20, 1 << 20, 16, 64 << 10
#: Characters up to which a sampled page is empty; of four samples, how many must be; empty pages looked at for images.
EMPTY, OF, AT_LEAST, IMAGES = 0, 4, 3, 2


def rules_hash(before: tuple[str, ...] = KEEP_BEFORE, after: tuple[str, ...] = KEEP_AFTER) -> str:
    """A fingerprint (32-bit FNV-1a) of the lists that line joins go by: pages made by other rules are made again."""
    h = 0x811C9DC5
    for c in f"h1|{','.join(sorted(before))}|{','.join(sorted(after))}".encode():
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return f"d1:{h:08x}"


def resume(algo: Column, rules: Column, now_rules: str) -> Column:
    """Why a document is read anew (algo, derived), or null: it goes on where it stopped."""
    return F.when(F.coalesce(algo, F.lit(0)) < ALGO, "algo").when(~rules.eqNullSafe(F.lit(now_rules)), "derived")


def cursor(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """docs (key, pages) with ``cursor``: the first page that is not among the done ones (key, page), one beyond the last if
    all are. As pages are ranked, those that stand at their own number make the unbroken beginning."""
    d = done.select(key, "page").distinct().where("page >= 1")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("page")))
    head = d.where("page = _n").groupBy(key).agg(F.max("page").alias("_m"))
    return docs.join(head, key, "left").withColumn("cursor", F.least(F.col("pages"), F.coalesce("_m", F.lit(0))) + 1).drop("_m")


def next_page(docs: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key, page, priority: what to read next of docs (key, pages, current): 0 the current page and its neighbours, 1 those five
    about it, 2 the first gap, 3 what failed before, once more; none if all is done."""
    seen = done.select(key, "page").unionByName(failed.select(key, "page")).distinct()
    offsets = [0, 1, -1, *(x for n in range(2, 6) for x in (n, -n))]
    near = docs.select(key, "pages", F.posexplode(F.transform(F.array(*map(F.lit, offsets)), lambda x: F.col("current") + x)).alias("order", "page"))
    near = near.where(F.col("page").between(1, F.col("pages"))).join(seen, [key, "page"], "left_anti").select(key, "page", F.when(F.col("order") < 3, 0).otherwise(1).alias("priority"), "order")
    gap = cursor(docs, seen, key).where("cursor <= pages").select(key, F.col("cursor").alias("page"), F.lit(2).alias("priority"), F.lit(0).alias("order"))
    again = failed.join(done.select(key, "page").distinct(), [key, "page"], "left_anti").join(docs.select(key), key, "left_semi").select(key, "page", F.lit(3).alias("priority"), F.col("page").cast("int").alias("order"))
    first = near.unionByName(gap).unionByName(again).groupBy(key).agg(F.min(F.struct("priority", "order", "page")).alias("x"))
    return first.select(key, "x.page", "x.priority")


def complete(docs: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """docs with ``complete``: every page is done and none failed."""
    bad = failed.select(key).distinct().withColumn("_f", F.lit(True))
    return cursor(docs, done, key).join(bad, key, "left").withColumn("complete", (F.col("cursor") > F.col("pages")) & F.col("_f").isNull()).drop("_f")


def reread(cache: DataFrame, fresh: DataFrame, dirty: DataFrame, key: list[str]) -> DataFrame:
    """The cache with its dirty rows (key) read again: replaced by the fresh ones, gone where there is none."""
    d = dirty.select(*key).distinct()
    return cache.join(d, key, "left_anti").unionByName(fresh.join(d, key, "left_semi").select(cache.columns))


def job(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """requests (key, seq) with ``how``: hit if the cache has the key, send for the first request of a key, share for others
    that wait for its answer."""
    c = cache.select(key).distinct().withColumn("_c", F.lit(True))
    first = F.row_number().over(Window.partitionBy(key).orderBy("seq")) == 1
    return requests.join(c, key, "left").withColumn("how", F.when(F.col("_c"), "hit").when(first, "send").otherwise("share")).drop("_c")


def sample_ranges(size: Column, full: int = FULL, edge: int = EDGE, samples: int = SAMPLES, piece: int = PIECE) -> Column:
    """array(lo, hi): the bytes of a file that its hash is made of. Ranges that meet are one."""
    lo, hi = F.lit(edge).cast("long"), size - edge
    start = lambda i: F.greatest(lo, F.least(hi - piece, lo + F.floor((hi - lo) * ((i + 0.5) / samples)) - piece // 2))
    one = lambda a, b: F.struct(a.cast("long").alias("lo"), b.cast("long").alias("hi"))
    middle = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: one(start(i), start(i) + piece))
    every = F.array_sort(F.concat(F.array(one(F.lit(0), lo), one(hi, size)), F.when(hi > lo, middle).otherwise(F.slice(middle, 1, 0))))

    def merge(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one(last["lo"], F.greatest(last["hi"], r["hi"]))))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["lo"] <= last["hi"], joined).otherwise(F.concat(acc, F.array(r)))

    merged = F.aggregate(every, F.slice(every, 1, 0), merge)
    return F.when(size <= 0, F.slice(every, 1, 0)).when(size <= full, F.array(one(F.lit(0), size))).otherwise(merged)


@pandas_udf(StringType())
def identity(content: pd.Series, ranges: pd.Series) -> pd.Series:
    """A file's name by content: SHA-256 over its size, the number of ranges, and the bytes of the ranges."""

    def one(data, parts):
        if data is None:
            return None
        data = bytes(data)
        cut = [(int(r["lo"]), int(r["hi"])) for r in parts]
        h = hashlib.sha256(f"{len(data)}:{len(cut)};".encode() + b"".join(data[a:b] for a, b in cut)).hexdigest()
        return f"s256:{h}" if cut == [(0, len(data))] else f"s256:p:{len(data)}:{h}"

    return pd.Series([one(d, r) for d, r in zip(content, ranges)])


def stored(lines: DataFrame, key: list[str]) -> DataFrame:
    """Pages of lines (key, seq, text, x, y, size) as one row each: texts, and numbers at two decimals, in order."""
    two = lambda c: F.round(c, 2).alias(c)
    g = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "text", two("x"), two("y"), two("size")))).alias("l"))  # a page's lines
    return g.select(*key, F.lit(ALGO).alias("algo"), *[F.col(f"l.{c}").alias(c) for c in ("seq", "text", "x", "y", "size")])


#: How a line was written before: version 0 kept a page as one JSON text of lines, with numbers in hundredths and no size
#: where it was the page's own.
_OLD_LINE = "array<struct<n:bigint,t:string,x:bigint,y:bigint,s:bigint>>"


def stored_as_before(lines: DataFrame, key: list[str]) -> DataFrame:
    """Pages of lines (key, seq, text, x, y, size) as version 0 wrote them: ``body`` and the page's commonest size."""
    hundred = lambda c: F.round(F.col(c) * 100).cast("long")
    sizes = lines.groupBy(*key, hundred("size").alias("_s")).agg(F.count("*").alias("_c")).groupBy(*key).agg(F.max_by("_s", F.struct("_c", -F.col("_s"))).alias("own"))
    j = lines.join(sizes, key)
    line = F.struct(F.col("seq").cast("long").alias("n"), F.col("text").alias("t"), hundred("x").alias("x"), hundred("y").alias("y"), F.when(hundred("size") != F.col("own"), hundred("size")).alias("s"))
    g = j.groupBy(*key, "own").agg(F.array_sort(F.collect_list(line)).alias("l"))  # a page's lines
    return g.select(*key, F.lit(0).alias("algo"), F.to_json("l").alias("body"), "own")


def loaded(pages: DataFrame, key: list[str]) -> DataFrame:
    """The lines out of stored pages, each by the version that wrote it: this one keeps columns, version 0 a ``body`` (with
    ``own``, the size of lines that name none). Pages of a later version, or without one, are not read."""
    fields = ("seq", "text", "x", "y", "size")
    types = dict(pages.dtypes)
    out = None
    if "seq" in types:
        out = pages.where(F.col("algo") == ALGO).select(*key, F.inline(F.arrays_zip(*fields))).select(*key, *fields)
    if "body" in types:
        old = pages.where(F.col("algo") == 0).select(*key, "own", F.explode(F.from_json("body", _OLD_LINE)).alias("l"))
        part = lambda c: c.cast("double") / 100
        old = old.select(*key, F.col("l.n").alias("seq"), F.col("l.t").alias("text"), part(F.col("l.x")).alias("x"), part(F.col("l.y")).alias("y"), part(F.coalesce("l.s", "own")).alias("size"))
        out = old if out is None else out.unionByName(old)
    return out


def needs_scan(version: Column, now: int) -> Column:
    return F.coalesce(version, F.lit(0)) < now


def image_pages(samples: DataFrame, key: str) -> DataFrame:
    """key, page: the first empty pages, of documents most of whose samples (key, page, chars) are empty, to be looked at for
    images."""
    empty = F.col("chars") <= EMPTY
    all_ = Window.partitionBy(key)
    s = samples.withColumn("_e", F.count_if(empty).over(all_)).withColumn("_n", F.count("*").over(all_)).where(empty & (F.col("_e") * OF >= F.col("_n") * AT_LEAST))
    return s.withColumn("_r", F.row_number().over(all_.orderBy("page"))).where(F.col("_r") <= IMAGES).select(key, "page")


def scan_records(results: DataFrame, before: DataFrame, key: str, version: int) -> DataFrame:
    """results (key, verdict) as records: that a reader was told stays known if the new verdict is of the old one's kind."""
    kind = lambda v: F.when(v.isin("scan", "notext"), "scan").when(v == "garbled", "garbled")
    b = before.select(key, F.col("verdict").alias("_v"), F.col("noticed").alias("_n"))
    j = results.join(b, key, "left")
    told = F.coalesce(F.col("_n") & (kind(F.col("_v")) == kind(F.col("verdict"))), F.lit(False))
    return j.select(key, F.lit(version).alias("v"), "verdict", told.alias("noticed"))


def request_tokens(*parts: Column) -> Column:
    return sum(parts[1:], parts[0])
