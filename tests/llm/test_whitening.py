import math
import random
import struct

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.common import read
from tessera.llm.whitening import Moments, symmetric_qr, whiten


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, top=4):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in ok)
    ok = [(i, tuple(x + [0] * (width - len(x)))) for i, x in ok]
    fit = sorted({x for _, x in ok})
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    y = np.array([[(n * a - s) for a, s in zip(x, sums)] for x in fit], object)
    v = ((y.T @ y) / n**3).astype(np.float64)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in ok:
        d = [n * a - s for a, s in zip(x, sums)]
        w = (np.array([float(a) for a in d]) / n) @ q
        out.append((i, n, sum(a * a for a in d), [w[k] / math.sqrt(e[k]) for k in range(min(top, width))], [e[k] / e.sum() for k in range(min(top, width))]))
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation_digits), []).append(r)
    signs = {}
    assert len(got) == sum(len(w[3]) for w in want)
    for i, n, dev, white, share in want:
        own = {r.component: r for r in by[i, str(dev)]}
        assert sorted(own) == list(range(1, len(white) + 1))
        for k, (w, s) in enumerate(zip(white, share), 1):
            r = own[k]
            assert r.n == n and r.deviation == (dev if dev < 2**63 else None)
            assert abs(r.explained - s) <= 1e-9 * s
            if abs(w) > 1e-6:
                assert signs.setdefault(k, math.copysign(1, w * r.whitened)) == math.copysign(1, w * r.whitened)
            assert abs(abs(r.whitened) - abs(w)) <= 1e-8 * max(1, abs(w))
            assert r.identity_error <= 1e-9


def test_symmetric_qr():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 64):
        a = r.normal(size=(n, n))
        for m in (a + a.T, np.diag(a.diagonal()), np.zeros((n, n)), np.ones((n, n)), a @ np.diag(10.0 ** -np.arange(n)) @ a.T):
            m = (m + m.T) / 2
            e, q = symmetric_qr(m)
            assert np.abs(q @ q.T - np.eye(n)).max() < 1e-13
            assert np.abs(q @ m @ q.T - np.diag(e)).max() <= 1e-13 * max(1, np.abs(m).sum())
            assert (np.diff(e) <= 0).all()


def test_moments_merge_to_those_of_all():
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 5)) + 1e6
    parts = []
    for a, b in ((0, 1), (1, 1), (1, 60), (60, 200)):
        m = Moments.none(5)
        for row in x[a:b]:
            m.take(row)
        parts.append(m)
    whole = parts[0]
    for m in parts[1:]:
        whole = whole.merge(m)
    assert whole.n == 200
    assert np.abs(whole.covariance() - np.cov(x.T, bias=True)).max() < 1e-8


@pytest.mark.parametrize("parts", [1, 30])
def test_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "MERGED", 3)
    r = random.Random(2)
    one = [f32(r.gauss(0, 0.3)) for _ in range(7)]
    rows = [(i, one if i % 3 == 0 else [f32(r.gauss(0.1 * j, 0.1 + 0.1 * j)) for j in range(7)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 6 + [float("nan")]), (302, [1.0] * 6 + [float("-inf")]), (303, [1.0] * 6 + [None]), (None, one), (5, [0.5] * 3), (5, []), (5, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, "z", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double").repartition(parts)
    compare(whiten(df).collect(), brute(rows))


def test_given_table(spark, small):
    df = read(spark, small, "embeddings")
    compare(whiten(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()]))


def test_little_spread_and_great_values(spark):
    schema = "vec_id long, embedding array<double>"
    got = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)}
    rows = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [1.0, 2.0]), (4, [3.0, -7.0])]
    got = {(r.vec_id, r.component): r for r in whiten(spark.createDataFrame(rows, schema)).collect()}
    fit = [[math.floor(256 * c) for c in v] for _, v in rows]
    for (i, _), x in zip(rows, fit):
        dev = sum((4 * a - s) ** 2 for a, s in zip(x, map(sum, zip(*fit))))
        assert got[i, 1].deviation_digits == str(dev) and got[i, 1].deviation == (dev if dev < 2**63 else None)
    assert got[1, 1].deviation is None and abs(got[1, 1].whitened) == pytest.approx(math.sqrt(2), rel=1e-9)
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [])], schema)).count() == 0
