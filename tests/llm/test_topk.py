import math
import random

from tessera.llm import topk
from tessera.llm.topk import neighbours


def brute(rows, every=50, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(x) * 256 if abs(x) > 2.0**60 else math.floor(256 * x) for x in v])
    out = []
    for q, vs in ok.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(min(vs), w)), i) for i, ws in ok.items() if i != q for w in ws)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "SQUAD", 3)
    r = random.Random(4)
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    one = [f32(r.gauss(0, 0.2)) for _ in range(6)]
    rows = [(i, one if r.random() < 0.3 else [f32(r.gauss(0, 0.2)) for _ in range(6)]) for i in range(430)]
    rows += [(430, None), (431, [1.0] * 5 + [float("nan")]), (432, [1.0] * 5 + [float("inf")]), (433, [1.0] * 5 + [None]), (None, one), (-50, one)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in neighbours(df).collect())
    assert got == brute(rows)


def exact(df):
    return sorted((x.query_id, x.rank, x.vec_id, int(x.digits)) for x in df.collect())


def test_no_size_of_a_component_is_clipped(spark):
    r = random.Random(9)
    rows = [(0, [2.0**41, 1.0]), (50, [1.0, 0.0]), (1, [2.0**54, 2.0]), (2, [2.0**54, 3.0]), (3, [-(2.0**1020), 1.0]), (4, [2.0**1020, 7.0]), (100, [1e300, -1e300])]
    rows += [(i, [r.gauss(0, 10.0 ** r.randrange(60)), r.gauss(0, 1)]) for i in range(5, 40)]
    for some in (rows[:2], rows[:4], rows):
        got = neighbours(spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(3))
        assert exact(got) == brute(some)
        assert all(x.score == (int(x.digits) if abs(int(x.digits)) < 2**63 else None) for x in got.collect())
    assert (50, 1, 0, 2**57) in exact(neighbours(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")))
    n = [0, 1, -1, 9, 10, -10, -9, 10**400, -(10**400), 2**64, -(2**64), 123, -123]
    assert sorted(n, key=topk.sort_key) == sorted(n)


def test_blocks_dealt_in_turn(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGES", 2)
    monkeypatch.setattr(topk, "SHARD", 30)
    monkeypatch.setattr(topk, "BLOCK", 4)
    r = random.Random(3)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(3)]) for i in range(200)]
    assert exact(neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_repeated_queries_and_great_components(spark):
    rows = [(0, [0.5, 1.0]), (0, [-0.5, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for n in (1, 5):
        assert exact(neighbours(df.repartition(n))) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [-0.5]), (7, [0.25])], "vec_id long, embedding array<float>")
    assert [(x.vec_id, x.score) for x in neighbours(df).orderBy("rank").collect()] == [(7, 128 * 64), (1, -128 * 128)]
    assert neighbours(df.limit(0)).count() == 0


def test_given_table(spark, small):
    from tessera.llm.common import read

    df = read(spark, small, "embeddings")
    assert exact(neighbours(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])
