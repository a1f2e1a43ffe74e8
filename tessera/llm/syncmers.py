"""Document fingerprints of closed syncmers. DataFrame functions only.

A text's letters are its words; where no blank parts them (ideographs, kana, runs of more than LONGEST characters) they are
single characters, so what stands before a passage does not change how it is read. A k-mer is 5 letters in a row, its inner
substrings are the 4 pairs in it, and a closed syncmer is a k-mer whose least pair (by hash) is its first or last. Whether a
k-mer is one depends on itself alone, so equal passages have equal anchors wherever they stand.

The likeness of two texts is that of the sets of all their anchors. A fingerprint, as a text to be stored, is the 64 least
anchor hashes, in order, 8 hex digits each; a text without an anchor (any of under 5 letters) is one anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH = 64
#: Documents whose order one task finds, about, and the most ranges of ids that are told apart at once.
RANGE_ROWS, RANGES = 500, 1024


#: Characters of a word that is one letter at most.
LONGEST = 24
_BLANK, _IDEOGRAPHS = r"\x20\x09-\x0D", r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
LETTER = rf"[^{_BLANK}{_IDEOGRAPHS}]{{1,{LONGEST}}}(?![^{_BLANK}{_IDEOGRAPHS}])|[^{_BLANK}]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTER), F.lit(0))


def _hashed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out_p (hashes of pairs of words) and out_h (the hash of all words)."""
    df = df.withColumn(f"{out}_w", F.transform(_words(F.col(text)), lambda x: F.xxhash64(x)))
    pairs = f"zip_with({out}_w, slice({out}_w, 2, greatest(size({out}_w) - 1, 0)), (a, b) -> xxhash64(a, b))"
    return df.withColumn(f"{out}_p", F.expr(pairs)).withColumn(f"{out}_h", F.xxhash64(f"{out}_w")).drop(f"{out}_w")


def _places(pairs: str) -> str:
    """1-based places of closed syncmers among the k-mers; the last pair of zip_with has a null second word."""
    return f"filter(sequence(1, size({pairs}) - 4), i -> least({pairs}[i - 1], {pairs}[i + 2]) <= least({pairs}[i], {pairs}[i + 1]))"


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, at, anchor) of docs (doc_id, text): the word number and hash of each closed syncmer, for positional matching."""
    d = _hashed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "t").where("size(t_p) >= 5")
    d = d.select("doc_id", "t_p", F.explode(F.expr(_places("t_p"))).alias("at"))
    return d.select("doc_id", "at", F.expr("xxhash64(t_p[at - 1], t_p[at + 1], t_p[at + 2])").alias("anchor"))


def _anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the set of anchor hashes. A column at a time, so that none is computed twice."""
    df = _hashed(df, text, out)
    anchor = f"transform({_places(out + '_p')}, i -> xxhash64({out}_p[i - 1], {out}_p[i + 1], {out}_p[i + 2]))"
    df = df.withColumn(out, F.expr(f"IF(size({out}_p) < 5, cast(array() AS array<bigint>), {anchor})")).drop(f"{out}_p")
    return df.withColumn(out, F.array_distinct(F.expr(f"IF(size({out}) = 0, array({out}_h), {out})"))).drop(f"{out}_h")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the anchors of both texts together, how many are in both."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def _hex(anchors: Column) -> Column:
    least = F.slice(F.sort_array(F.array_distinct(F.transform(anchors, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))), 1, SKETCH)
    return F.concat_ws("", F.transform(least, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document's text in descending doc_id, and the first's after the last.

    Ids fall into ranges of about RANGE_ROWS rows by their quantiles; a range's rows are put in order together, and what
    follows its last row is the head of the next range that has rows. Null ids come last, in the order of their texts' hashes
    and dealt by them; rows that share an id stand in the order of their texts and are put in order by one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    m = max(1, min(RANGES, n // RANGE_ROWS))
    inner = max(1, -(-n // (RANGES * RANGE_ROWS * 8)))  # equal widths inside a quantile, for very large tables
    got = docs.agg(F.percentile_approx("doc_id", [i / m for i in range(m + 1)], 20 * m)).first()[0] or [0, 0]
    edges = sorted(set(got))
    lower = F.lit(edges[:-1] or edges[:1]).cast("array<bigint>")
    part = F.size(F.filter(lower, lambda e: e <= F.col("doc_id")))
    if inner > 1:
        ends = F.lit(edges[1:] or edges[:1]).cast("array<bigint>")
        i = F.greatest(part, F.lit(1))
        width = F.greatest(F.element_at(ends, i) - F.element_at(lower, i), F.lit(1)).cast("double")
        sub = F.floor((F.col("doc_id") - F.element_at(lower, i)) / width * inner)
        part = part * F.lit(inner + 1) + F.least(F.greatest(sub, F.lit(0)), F.lit(inner))
    nulls = -1 - F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * (m * inner)).cast("long")  # rows without an id, by their texts' hashes
    rows = docs.withColumn("part", F.coalesce(part.cast("long"), nulls))
    order = [F.col("doc_id").desc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.col("text")]
    within = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(within)).withColumn("next_text", F.lead("text").over(within)).withColumn("last", F.lead(F.lit(1)).over(within).isNull())

    heads = rows.where("rank = 1").select("part", F.col("text").alias("head"))
    parts = heads.select("part")
    after = Window.orderBy(F.col("part").desc())
    parts = parts.select("part", F.lead("part").over(after).alias("next"), F.max("part").over(Window.partitionBy()).alias("top"))
    follow = parts.select(F.col("part").alias("p"), F.coalesce("next", "top").alias("next")).join(heads.withColumnRenamed("part", "q"), F.col("next") == F.col("q")).select("p", "head")
    out = rows.join(follow, (F.col("part") == F.col("p")) & F.col("last"), "left")
    return out.select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text (its last third is the next document's beginning), and how
    like the first is to the second and to the next document's. Null texts are empty; rows that share an id, or have none,
    each have a row; an empty table gives an empty result."""
    d = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third)))
    for text, out in (("text", "f"), ("edited", "e"), ("next_text", "x")):
        d = _anchors(d, text, out)
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _hex(F.col("f")).alias("fingerprint"), _hex(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"))
