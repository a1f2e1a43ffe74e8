import random

import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm.neardup import drop_near_duplicates, near_groups


def shingles(t, k=5):
    w = t.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_copies_are_caught_and_others_stay(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts, of = [], []
    for g in range(60):
        t = [word() for _ in range(r.randint(80, 700))]
        texts.append(" ".join(t))
        of.append(g)
        for _ in range(r.randint(0, 3) if g else 150):
            u = list(t)
            for _ in range(max(1, len(u) // r.randint(80, 400))):
                u[r.randrange(len(u))] = word()
            texts.append(" ".join(u).upper() if r.random() < 0.2 else " ".join(u))
            of.append(g)
    texts += [texts[0], None, "", "one two", "one two"]
    of += [0, -1, -1, -2, -2]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = {x.doc_id: x.group for x in near_groups(df).collect()}
    by = {}
    for i, g in enumerate(of):
        by.setdefault(got[i], set()).add(g)
    assert all(len(v) == 1 for v in by.values())  # no clean document is lost
    missed = [i for i, t in enumerate(texts) if of[i] >= 0 and jaccard(t, texts[of.index(of[i])]) >= 0.85 and got[i] != got[of.index(of[i])]]
    assert len(missed) <= 0.03 * len(texts), len(missed)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    left = sorted(x.doc_id for x in out.collect())
    assert {of[i] for i in left} == set(of) and len(left) == len(set(got.values()))


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    assert sorted(x.doc_id for x in drop_near_duplicates(df).collect()) == [5, 6]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_clusters_are_components_of_close_rows():
    r = np.random.default_rng(3)
    fp = r.integers(0, 2**63, (700, 2), dtype=np.uint64)
    for i in range(1, 700):
        if r.random() < 0.7:
            bits = r.choice(128, r.integers(1, 14), replace=False)
            fp[i] = fp[i - 1] if r.random() < 0.5 else fp[max(0, i - 40)]
            for x in bits:
                fp[i, x // 64] ^= np.uint64(1) << np.uint64(x % 64)
    begin = np.array([0, 1, 30, 31, 90, 400, 700])
    got = neardup.clusters(begin, fp, 10)
    for s, e in zip(begin[:-1], begin[1:]):
        near = np.bitwise_count(fp[s:e, None] ^ fp[None, s:e]).sum(2) <= 10
        label = np.arange(s, e)
        while True:
            new = np.where(near, label[None], 10**6).min(1)
            if (new == label).all():
                break
            label = new
        assert got[s:e].tolist() == label.tolist()


def test_verify_equals_all_pairs(monkeypatch):
    r = np.random.default_rng(4)
    sets = []
    for _ in range(20):
        base = r.integers(0, 2**32, r.integers(1, 400), dtype=np.uint32)
        for _ in range(r.integers(1, 6)):
            x = base.copy()
            k = r.integers(0, len(x) // 6 + 1)
            x[:k] = r.integers(0, 2**32, k, dtype=np.uint32)
            sets.append(np.unique(x))
    i, j, sure = neardup.verify(sets, 0.8)
    assert sure.all()
    m = len(sets)
    jac = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert all(jac(a, b) >= 0.8 for a, b in zip(i, j))

    def roots(links):
        root = list(range(m))
        for a, b in links:
            root = [root[a] if x == root[b] else x for x in root]
        return root

    want, got = roots([(a, b) for a in range(m) for b in range(a) if jac(a, b) >= 0.8]), roots(zip(i.tolist(), j.tolist()))
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(m) for b in range(a))
    assert len(i) == m - len(set(got))


def test_groups_above_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        t[r.randrange(200)] = word()
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len({x.group for x in near_groups(df).collect()}) == 1


def test_copies_among_texts_with_one_boilerplate(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def changed(t, k):
        at = r.randrange(5, len(t) - k - 5)
        return t[:at] + [word() for _ in range(k)] + t[at + k :]

    base = [word() for _ in range(120)]
    texts = []
    for _ in range(70):
        t = changed(base, 6)
        texts += [" ".join(t), " ".join(changed(t, 7))]
    r.shuffle(texts)
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.group for x in near_groups(df).collect()}
    lost = sum(got[i] != got[j] for i, j in links)
    root = list(range(len(texts)))
    for i, j in links:
        root = [root[i] if x == root[j] else x for x in root]
    assert all(root[i] == root[j] for i in got for j in got if got[i] == got[j])
    assert lost <= 0.01 * len(links)


def test_long_texts_at_the_bound(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for g in range(40):
        t = [word() for _ in range(700)]
        u = list(t)
        while jaccard(" ".join(t), " ".join(u)) > (0.815 if g % 2 else 0.795):
            u[r.randrange(len(u))] = word()
        texts += [" ".join(t), " ".join(u)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.group for x in near_groups(df).collect()}
    assert len(set(got.values())) >= 60
    for i in range(0, 80, 4):
        assert got[i] != got[i + 1]  # under 0.8
    assert sum(got[i] != got[i + 1] for i in range(2, 80, 4)) <= 3  # over 0.8, but for segments that all differ


def test_shapes_keep_the_chance(spark):
    import math

    for n, want in ((0, (9, 16)), (10**6, (9, 16)), (2**27, (9, 16)), (2**28, None), (10**10, None)):
        segments, bits = neardup.shape_for(n, 0.8)
        assert want is None or (segments, bits) == want
        p = math.acos(1.6 / 1.8) / math.pi
        close = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        assert 0.945 <= 1 - (1 - close) ** segments < 0.97 and n <= neardup.BUCKET << bits - 1 or n == 0
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        t = [word() for _ in range(300)]
        u = list(t)
        for _ in range(3):
            u[r.randrange(300)] = word()
        texts += [" ".join(t), " ".join(u)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for shape in (None, (13, 19)):
        got = {x.doc_id: x.group for x in near_groups(df, shape=shape).collect()}
        assert sum(got[i] == got[i + 1] for i in range(0, 80, 2)) >= 39 and len(set(got.values())) <= 41


def test_whole_keys_out_of_any_batches(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    for at_once in (1, 5, 40):
        monkeypatch.setattr(neardup, "AT_ONCE", at_once)
        keys = sorted(r.choice([1, 2, 3, 50, 51, 52, 53]) for _ in range(200))
        rows = list(zip(keys, range(200)))
        batches, at = [], 0
        while at < 200:
            n = r.randint(0, 17)
            batches.append(pa.RecordBatch.from_pydict({"k": [x[0] for x in rows[at : at + n]], "v": [x[1] for x in rows[at : at + n]]}, schema=pa.schema([("k", pa.int64()), ("v", pa.int64())])))
            at += n
        for shift in (0, 1):
            seen, out = set(), []
            for begin, t in neardup._by_key(batches, shift):
                k = t.column(0).to_numpy() >> shift
                assert begin[0] == 0 and begin[-1] == len(k) and all(len(set(k[a:b])) == 1 for a, b in zip(begin[:-1], begin[1:]))
                assert not seen & set(k.tolist()) and len(begin) - 1 == len(set(k.tolist()))
                seen |= set(k.tolist())
                out += t.column(1).to_pylist()
            assert out == list(range(200))
