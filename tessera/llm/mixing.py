"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Saved

#: A source's weight by its place in the order of sources, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own size.
MOST = 3
#: Rows of one source and size class that one task ranks, about; and the least number of such blocks.
BLOCK_ROWS, LEAST_BLOCKS = 100_000, 64
#: Above twice the class of any size.
TURN = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target out of (source, source_size), one row for each source.

    Sources share 100 % of all sizes by weight; a target stops at ``most`` times its source's size, and the excess is
    shared by weight until none is above. That is a water level: in the order of size to weight, the first sources are
    full, and the rest share what is left in proportion to their weights. One row a source: small by nature.
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(at) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything))
    )
    # the level if all sources before this one are full; the true one is the first that does not fill its own source
    level = (F.col("all") - F.col("full")) / F.col("w_left")
    rows = rows.withColumn("level", F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), level.alias("x")))).over(everything)["x"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``row`` (the input row), size, source_size, target and copies (how often the mix takes the document).

    Systematic sampling: in each source, documents stand in an order (size classes up and down again, then blocks at
    random, then size), so that both ends are small and the offset does not shift the total; each counts its expected copies, target / source_size, and the running sum plus one random offset of the source is
    cut at whole numbers: a document is taken once for each that its step crosses. So a document is taken at most
    ``most`` times, a source's total is off by little more than the sizes of a few documents, and reruns agree.

    Running sums need no task to see a whole source: blocks (source, size class, random block) are counted first, then
    summed in two small steps, and only a block's own rows are ranked together. Null texts and sources without words
    have size 0 and target 0; rows with one doc_id are each a document; an empty table gives an empty result.
    """
    n = docs.count()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    size = word_count(F.col(text))
    digest = F.xxhash64(F.col(text))  # which of several rows that share an id and a size comes first
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("id"), size.alias("size"), digest.alias("digest"))
    return _place(rows, blocks, seed, weights, most)


def _place(rows: DataFrame, blocks: int, seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows: source, id, size, digest and any others but the names used here."""
    rows = rows.withColumn("dice", F.xxhash64(F.lit(seed), "id"))
    up = F.shiftrightunsigned("dice", 40) % 2 == 0  # half of the documents by rising size, then the others by falling size
    step = F.floor(8 * F.log2(F.col("size") + 1)).cast("int")
    rows = rows.withColumn("class", F.when(up, step).otherwise(TURN - step)).withColumn("block", F.pmod("dice", F.lit(blocks)).cast("int"))
    counts = Saved(rows.groupBy("source", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))).df  # read thrice
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)

    def before(*by: str) -> Window:
        return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.coalesce(F.sum("n").over(before("source", "class")), F.lit(0)).alias("class_at"))
    places = counts.select("source", "class", "block", F.coalesce(F.sum("n").over(before("source", "class", "block")), F.lit(0)).alias("block_at"))
    places = places.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select("source", "class", "block", (F.col("class_at") + F.col("block_at")).alias("at"))
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    places = places.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("block").alias("b"), "at", "source_size", "target")

    rank = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy(F.when(F.col("class") < TURN // 2, F.col("size")).otherwise(-F.col("size")), "dice", "id", "digest"))
    ranked = rows.withColumn("rank", rank)
    placed = ranked.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("block") == F.col("b")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))), F.lit(1 << 30)) / float(1 << 30)
    upto = F.col("at") + F.col("rank")
    return placed.withColumn("copies", F.least(F.lit(most), F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)).cast("int"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated or left out."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def mix_digest(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken: words that the mix takes from the document, repeats counted."""
    out = mix(docs.select("doc_id", "text", "source"), seed=seed)
    return out.select(F.col("id").cast("long").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
