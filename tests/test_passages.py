import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import passages

SCHEMA = "k string, page int, para string, pos int, chars int, sent int, summarised boolean, candidate boolean"


def turned(i):
    out, w = 0.0, 0.5
    while i:
        out += w * (i & 1)
        i, w = i >> 1, w / 2
    return out


def brute(rows, budget):
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        load = {}
        for r in own:
            load[r[1]] = load.get(r[1], 0) + r[5]
        c = [r for r in own if r[7]]
        order = []
        for g in sorted({r[5] * 2 + (not r[6]) for r in c}):
            group = [r for r in c if r[5] * 2 + (not r[6]) == g]
            pages = sorted({r[1] for r in group})
            turn = sorted(range(len(pages)), key=lambda i: (load[pages[i]], turned(i), i))
            by = {p: sorted((r for r in group if r[1] == p), key=lambda r: r[3]) for p in pages}
            order += [by[pages[i]][n] for n in range(len(group)) for i in turn if n < len(by[pages[i]])]
        used, took = 0, []
        for r in order:
            if used + r[4] <= budget:
                used += r[4]
                took.append((r[2], used))
        for n, (para, total) in enumerate(took, 1):
            out[key, n] = (para, total, len(c) - len(took))
    return out


@pytest.mark.parametrize("seed,budget", [(1, 100), (2, 1000), (3, 5), (4, 37)])
def test_against_brute_force(spark, seed, budget):
    r = random.Random(seed)
    rows = [("abc"[min(2, r.randrange(5))], r.randrange(12), f"p{i}", i, r.choice([0, 1, 2, 3, 7, 30, 31, 64, 99, r.randrange(120)]), r.randrange(3), r.random() < 0.3, r.random() < 0.8) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = passages.chosen(passages.ordered(df, "k"), "k", budget).collect()
    assert {(x.k, x.place): (x.para, x.total, x.left) for x in got} == brute(rows, budget)
    assert passages.chosen(passages.ordered(df.limit(0), "k"), "k", budget).count() == 0


def test_few_rows_reach_the_fold(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("int").alias("chars"), F.struct("id").alias("turn"))
    n = passages._needed(rows.where("chars > 0"), ["k"], 1000).count()
    assert n < 3000
