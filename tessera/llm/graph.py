"""Connected components over links, by alternating stars. Links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved


def _large(e: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is hung on the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node itself, are hung on the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Links that one file of a round holds, about.
ROWS = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node that it reaches. Self links are ignored.

    Every round at least halves the distance to the root in practice; rounds are written to the shared folder, so a lost
    executor costs one round at most. A round has about as many links as the one before, which says how many files it fills.
    """
    now = Saved(links.select("a", "b").where("a <> b"))
    state = None
    while True:
        after = _small(_large(now.df))
        after = Saved(after.coalesce(state[0] // ROWS + 1) if state else after)
        is_now = tuple(after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now.drop()
        now = after
        if is_now == state or not is_now[0]:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = is_now
