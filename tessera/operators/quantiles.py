"""Exact quantiles of large columns, by narrowing down to the rows about a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be sorted together; edges that a pass counts.
SORTED, EDGES = 1_000_000, 64


def at_rank(rows: DataFrame, value: str, rank: int) -> float | None:
    """The value at a 0-based rank. Each pass counts the rows below some edges, which approximate quantiles give, and keeps
    those between the two edges about the rank, until few enough are left to sort. Nothing grows with the input but the
    number of passes, by its logarithm."""
    while True:
        n = rows.count()
        if rank >= n or rank < 0:
            return None
        if n <= SORTED:
            return rows.orderBy(value).offset(rank).limit(1).first()[0]
        edges = sorted(set(rows.agg(F.percentile_approx(value, [i / EDGES for i in range(EDGES + 1)], 1000)).first()[0]))
        counts = rows.agg(*[c for i, e in enumerate(edges) for c in (F.count_if(F.col(value) < e).alias(f"b{i}"), F.count_if(F.col(value) <= e).alias(f"u{i}"))]).first()
        low = high = None
        for i, e in enumerate(edges):
            if counts[f"b{i}"] <= rank < counts[f"u{i}"]:
                return e
            if counts[f"u{i}"] <= rank:
                low = (e, counts[f"u{i}"])
            elif high is None:
                high = e
        rows = rows.where((F.lit(True) if low is None else F.col(value) > low[0]) & (F.lit(True) if high is None else F.col(value) < high))
        rank -= low[1] if low else 0


def quantiles(df: DataFrame, value: Column, fractions: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation; nulls do not count; no rows: None."""
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    n = rows.count()
    found: dict[int, float | None] = {}
    out = []
    for f in fractions:
        at = f * (n - 1)
        lo = int(at)
        for r in (lo, lo + 1):
            if r not in found:
                found[r] = at_rank(rows, "v", r) if r < n else None
        a, b = found.get(lo), found.get(lo + 1)
        out.append(a if a is None or b is None or at == lo else a + (b - a) * (at - lo))
    return out
