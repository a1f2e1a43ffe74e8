"""Ordered rows: paragraphs out of lines, chunks under a budget, spread orders, exams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import let
from tessera.session import stored

#: Beginnings and ends of words that keep their hyphen at a line's end (fixed values).
KEEP_BEFORE = (
    "anti", "non", "self", "post", "pre", "pro", "co", "re", "intra", "inter", "sub", "semi", "multi", "pseudo", "extra", "ultra", "cross", "long", "short",
    "high", "low", "first", "second", "well", "x", "t", "b", "gram", "de", "ex",
)
KEEP_AFTER = (
    "associated", "resistant", "susceptible", "converting", "induced", "mediated", "clavulanate", "tazobactam", "oophorectomy", "dependent", "related",
    "negative", "positive", "specific", "based", "sparing", "releasing", "stimulating", "binding", "blocking", "deficient", "lowering", "onset",
)


def join_lines(lines: Column) -> Column:
    """One text out of an array of lines. A hyphen at a line's end, after a letter and before a small one, goes with the
    line break; a word that keeps its hyphen (KEEP_BEFORE as its last part, or KEEP_AFTER as the next line's first word)
    only loses the break. Blank lines do not count. Each line looks at the next one alone, so a text takes time in
    proportion to its length."""
    real = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))), lambda x: x != "")

    def piece(line: Column, after: Column) -> Column:
        head, tail = F.lower(F.regexp_extract(line, "([A-Za-z]+)-$", 1)), F.regexp_extract(after, "^[a-z]+", 0)
        broken = (head != "") & (tail != "")
        kept = head.isin(*KEEP_BEFORE) | tail.isin(*KEEP_AFTER)
        return F.when(after.isNull() | (broken & kept), line).when(broken, F.regexp_replace(line, "-$", "")).otherwise(F.concat(line, F.lit(" ")))

    return let(real, lambda all_: F.array_join(F.transform(all_, lambda x, i: piece(x, F.get(all_, i + 1))), ""))


def islands(df: DataFrame, key: str, order: list[str], new: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows: a row that is ``new`` begins one."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(new | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_clusters(df: DataFrame, key: str, at: str, gap: float, out: str = "cluster") -> DataFrame:
    """Points of a key that are no more than ``gap`` apart from the one before are one cluster."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("_d", F.col(at) - F.lag(at).over(w)).withColumn(out, F.sum(F.when(F.col("_d") > gap, 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_d")


#: Rows of a block of chunks().
ROWS = 4096


def _filled(sizes: np.ndarray, most: float, items: int, total: float, n: int) -> tuple[np.ndarray, float, int]:
    """Which rows begin a chunk, if the open one holds ``n`` rows of ``total``; and the same of the one open at the end. An open
    chunk without rows takes the first."""
    heads = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if n and (total + size > most or items and n >= items):
            total, n, heads[i] = 0, 0, True
        total, n = total + size, n + 1
    return heads, total, n


def chunks(df: DataFrame, key: str, order: list[str], size: str, most: int, items: int = 0, rows: int = ROWS) -> DataFrame:
    """df with ``chunk``: in order, rows fill a chunk until the next would pass ``most`` (or ``items`` rows). One row above
    ``most`` is a chunk alone. A null size is none.

    Keys are cut into blocks of ``rows``. How a block goes on from where its first new chunk begins does not depend on what came
    before, so each block says, for each row at which that may be, how many chunks follow and what is open at its end. In
    order of these summaries, which are as long as a chunk, it is found what each block starts from; then blocks are filled
    apart. No task sees the rows of a whole key.
    """
    names = [c for c in df.columns]
    parted = df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    parted = stored(parted.withColumn("_block", F.floor(n / rows).cast("int")).withColumn("_n", n).withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("double")))
    by = [key, "_part", "_block"]
    kind = dict(df.dtypes)[key]

    def summary(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_n")
        sizes = t["_size"].to_numpy(float)
        sums = np.cumsum(sizes)
        m = len(sizes)
        # after[p]: (chunks that begin from p on, total, rows) if one begins at p, from the end on
        after: list[tuple[int, float, int]] = [(0, 0.0, 0)] * (m + 1)
        for p in range(m - 1, -1, -1):
            q = int(np.searchsorted(sums, most + (sums[p] - sizes[p]), "right"))
            q = max(p + 1, min(q, p + items if items else m))
            after[p] = (1 + after[q][0], after[q][1], after[q][2]) if q < m else (1, float(sums[-1] - sums[p] + sizes[p]), m - p)
        reach = min(m, max(1, int(np.searchsorted(sums, most, "right"))) + 1, items + 1 if items else m)  # the first new chunk begins here at the latest
        one = t.iloc[[0]][by].reset_index(drop=True)
        return one.assign(m=m, all=float(sums[-1]), sums=[sums[:reach].tolist()], n=[[x[0] for x in after[:reach]]], total=[[x[1] for x in after[:reach]]], held=[[x[2] for x in after[:reach]]])

    said = parted.select(*by, "_n", "_size").groupBy(*by).applyInPandas(summary, f"`{key}` {kind}, _part int, _block int, m int, all double, sums array<double>, n array<int>, total array<double>, held array<int>")

    def begin(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["_part", "_block"])
        total, held, chunk, out = 0.0, 0, 0, []
        for m, all_, sums, n, totals, helds in zip(t["m"], t["all"], t["sums"], t["n"], t["total"], t["held"]):
            out.append((total, held, chunk))
            p = int(np.searchsorted(sums, most - total, "right")) if held else max(1, int(np.searchsorted(sums, most, "right")))
            p = min(p, items - held) if items else p
            if p < m:
                chunk, total, held = chunk + n[p], totals[p], helds[p]
            else:
                total, held = total + all_, held + m
        return t[by].assign(_total=[x[0] for x in out], _held=[x[1] for x in out], _chunk=[x[2] for x in out])

    starts = said.groupBy(key).applyInPandas(begin, f"`{key}` {kind}, _part int, _block int, _total double, _held int, _chunk int")
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("a._part") == F.col("c._part")) & (F.col("a._block") == F.col("c._block"))
    j = parted.alias("a").join(starts.alias("c"), same).select("a.*", "c._total", "c._held", "c._chunk")

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_n")
        heads, _, _ = _filled(t["_size"].to_numpy(float), most, items, float(t["_total"].iloc[0]), int(t["_held"].iloc[0]))
        return t[names].assign(chunk=(int(t["_chunk"].iloc[0]) + np.cumsum(heads)).astype("int32"))

    return j.groupBy(*by).applyInPandas(fill, ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("chunk", "int")]))


#: Values of an order that make a block of a running total.
WIDTH = 10_000


def running(df: DataFrame, key: str, order: str, amount: str, most: float, descending: bool = False, width: int = WIDTH) -> DataFrame:
    """The rows of each key, in a whole-number order, before whose ``amount`` the total of those before is under ``most``, with
    that total as ``before``. Blocks of the order are summed first, and only blocks that begin under the limit are looked
    into, each by itself: no task sees a whole key."""
    at = -F.col(order) if descending else F.col(order)
    rows = df.withColumn("_at", at).withColumn("_block", F.floor(at / width))
    sums = rows.groupBy(key, "_block").agg(F.sum(amount).alias("_sum"))
    head = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_head", head).where(F.col("_head") < most).select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_head")
    near = rows.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("before", F.col("_head") + inner).where(F.col("before") < most).drop("_at", "_block", "_k", "_b", "_head")


def spread(df: DataFrame, group: str, page: str, load: str, order: str, out: str = "turn") -> DataFrame:
    """A round-robin over pages: least load first, then by the bits of the page's place reversed, so neighbours part."""
    pages = df.select(group, page, load).groupBy(group, page).agg(F.max(load).alias("_load"))
    place = F.dense_rank().over(Window.partitionBy(group).orderBy(page)) - 1
    bits = F.conv(F.reverse(F.lpad(F.bin(place), 32, "0")), 2, 10).cast("long")
    pages = pages.withColumn("_bits", bits)
    rows = df.withColumn("_round", F.row_number().over(Window.partitionBy(group, page).orderBy(order))).join(pages, [group, page])
    w = Window.partitionBy(group).orderBy("_round", "_load", "_bits", page)
    return rows.withColumn(out, F.row_number().over(w)).drop("_round", "_load", "_bits")


def grade_sets(answer: Column, chosen: Column) -> Column:
    """Right if the same letters were chosen, in any order."""
    return (F.size(F.array_except(answer, chosen)) == 0) & (F.size(F.array_except(chosen, answer)) == 0)


def sparkline(rate: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"]), (F.floor(rate * 7 + 0.5) + 1).cast("int"))


def dense_histogram(df: DataFrame, value: str, slots: range) -> DataFrame:
    """Counts by value, with zero for slots that no row has."""
    all_slots = df.sparkSession.range(slots.start, slots.stop, slots.step, 1).withColumnRenamed("id", value)
    n = df.groupBy(F.col(value).cast("long").alias(value)).agg(F.count("*").alias("c"))
    return all_slots.join(n, value, "left").select(value, F.coalesce("c", F.lit(0)).alias("n"))
