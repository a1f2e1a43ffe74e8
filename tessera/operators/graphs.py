"""Diagrams: layers of an acyclic graph, lines that cross, outlines as numbered lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layers(edges: DataFrame, key: str) -> DataFrame:
    """key, node, level of acyclic graphs (key, a, b): the longest way to a node. A graph is a diagram of some tens of nodes, so
    one is levelled at a time, and all of them beside each other; nodes of a ring have no level."""

    def level(g: pd.DataFrame) -> pd.DataFrame:
        waits = g.groupby("b").size().to_dict()
        after = g.groupby("a")["b"].apply(list).to_dict()
        now = {n: 0 for n in {*g["a"], *g["b"]} - waits.keys()}
        todo, found = list(now), dict(now)
        while todo:
            n = todo.pop()
            for m in after.get(n, ()):
                now[m] = max(now.get(m, 0), found[n] + 1)
                waits[m] -= 1
                if not waits[m]:
                    found[m] = now[m]
                    todo.append(m)
        return pd.DataFrame({key: g[key].iloc[0], "node": list(found), "level": list(found.values())})

    t = dict(edges.dtypes)
    return edges.select(key, "a", "b").distinct().groupBy(key).applyInPandas(level, f"`{key}` {t[key]}, node {t['a']}, level int")


def crossings(edges: DataFrame, key: str) -> DataFrame:
    """key, n: pairs of a diagram's straight edges (key, a, b, x1, y1, x2, y2) that cross inside, without a common end. A
    diagram has some tens of edges."""
    side = lambda n: edges.select(F.col(key).alias("_k" + n), *[F.col(c).alias(c + n) for c in ("a", "b", "x1", "y1", "x2", "y2")])
    p, q = side("p"), side("q")
    turn = lambda a, b, c: (F.col("x" + b) - F.col("x" + a)) * (F.col("y" + c) - F.col("y" + a)) - (F.col("y" + b) - F.col("y" + a)) * (F.col("x" + c) - F.col("x" + a))
    apart = (F.col("ap") != F.col("aq")) & (F.col("ap") != F.col("bq")) & (F.col("bp") != F.col("aq")) & (F.col("bp") != F.col("bq"))
    cross = (turn("1p", "2p", "1q") * turn("1p", "2p", "2q") < 0) & (turn("1q", "2q", "1p") * turn("1q", "2q", "2p") < 0)
    once = F.struct("ap", "bp") < F.struct("aq", "bq")
    return p.join(q, (F.col("_kp") == F.col("_kq")) & once & apart & cross).groupBy(F.col("_kp").alias(key)).agg(F.count("*").alias("n"))


def outline_lines(points: Column) -> Column:
    """Points of points of points (t, sub) as lines ``1.2.3 text``; a blank one has no line, but keeps its number."""
    clean = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    line = lambda path, t: F.when(clean(t) != "", F.concat_ws(" ", path, clean(t)))
    path = lambda head, i: F.concat(head, F.lit("."), (i + 1).cast("string"))
    none = F.array().cast("array<string>")
    third = lambda head, sub: F.coalesce(F.transform(sub, lambda z, k: line(path(head, k), z["t"])), none)
    second = lambda head, sub: F.coalesce(F.flatten(F.transform(sub, lambda y, j: F.concat(F.array(line(path(head, j), y["t"])), third(path(head, j), y["sub"])))), none)
    one = lambda x, i: F.concat(F.array(line((i + 1).cast("string"), x["t"])), second((i + 1).cast("string"), x["sub"]))
    return F.array_compact(F.flatten(F.transform(points, one)))
