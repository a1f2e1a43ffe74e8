import random

import pandas as pd
import pytest

from tessera.operators import recurrence, shuffles


def generator(seed):
    """The seeded generator's numbers, by its definition."""
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
        t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        yield (t ^ t >> 14) / 4294967296


def shuffled(items, numbers):
    a = list(items)
    for i in range(len(a) - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        a[i], a[j] = a[j], a[i]
    return a


def test_shuffle_is_the_loops(spark):
    sizes = {0: 1, 1: 2, 2: 3, 3: 50, 4: 1000}
    rows = [(g, 10**9 * 7 + g * 12345, i, g) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g int, seed long, i int, skip int").repartition(3)
    got = {}
    for r in shuffles.fisher_yates(df, ["g"], ["i"], skip="skip").collect():
        got.setdefault(r.g, {})[r.place] = r.i
    for g, n in sizes.items():
        numbers = generator(10**9 * 7 + g * 12345)
        for _ in range(g):
            next(numbers)
        assert [got[g][p] for p in range(1, n + 1)] == shuffled(range(n), numbers)
    assert shuffles.fisher_yates(df.limit(0), ["g"], ["i"]).count() == 0


def test_exam_goes_on_with_one_generator(spark):
    pools = {"b": [3, 1, 2], "a": [9, 8, 7, 6, 5], "c": [4]}
    q = spark.createDataFrame([(n, i) for n, ids in pools.items() for i in ids], "node string, id int")
    exams = [(1, 42, 5), (2, 7, 100), (3, 2**31 - 2, 1)]
    got = {}
    for r in shuffles.exam(q, spark.createDataFrame(exams, "exam int, seed long, n int")).collect():
        got.setdefault(r.exam, {})[r.place] = r.id
    for e, seed, n in exams:
        numbers = generator(seed)
        own = {k: shuffled(sorted(pools[k]), numbers) for k in sorted(pools)}
        turn, out = shuffled(sorted(pools), numbers), []
        while len(out) < n and any(own.values()):
            out += [own[k].pop(0) for k in turn if own[k]]
        out = out[:n]
        assert [got[e][p] for p in range(1, len(out) + 1)] == out and len(got[e]) == len(out)


@pytest.mark.parametrize("adjust,alpha,block", [(True, 0.3, 4), (False, 0.3, 4), (True, 0.99, 512), (False, 0.05, 7), (True, 0.9, 3)])
def test_weighted_means_are_those_of_pandas(spark, adjust, alpha, block):
    r = random.Random(4)
    rows = [(k, i, None if r.random() < 0.2 else r.gauss(0, 5)) for k, n in (("a", 300), ("b", 1), ("c", 9), (None, 5)) for i in range(n)]
    df = spark.createDataFrame([(k, i, x, "z") for k, i, x in rows], "k string, i int, x double, ewm_of string").repartition(5)
    got = {(g.k, g.i): g.ewm for g in recurrence.ewm(df, ["k"], ["i"], "x", alpha, adjust, block).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", "c", None):
        own = [(i, x) for q, i, x in rows if q == k]
        want = pd.Series([x for _, x in own], dtype=float).ewm(alpha=alpha, adjust=adjust, ignore_na=not adjust).mean()
        for (i, _), w in zip(own, want):
            assert got[k, i] is None if pd.isna(w) else abs(got[k, i] - w) < 1e-9
    assert recurrence.ewm(df.limit(0), ["k"], ["i"], "x", alpha).count() == 0
