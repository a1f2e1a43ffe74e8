import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.simhash import simhash_components


def fp(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(fps, most=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉA.") for _ in range(r.randint(1, 6)))
    texts = [None, "", " \t\n", "One", "one two", "ONE two", "one  two\r\nthree", "x" * 5000]
    for _ in range(40):
        t = [word() for _ in range(r.randint(3, 400))]
        texts.append(r.choice([" ", "\n", "  "]).join(t))
        for _ in range(r.randint(0, 3)):
            u = list(t)
            u[r.randrange(len(u))] = word()
            texts.append(" ".join(u) + r.choice(["", " "]))
    return texts + texts[5:9]


def test_against_brute_force(spark):
    texts = made(1)
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: r for r in simhash_components(df).collect()}
    fps = [fp(t) for t in texts]
    assert len(got) == len(texts)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    root = roots(fps)
    least = {}
    for i, x in enumerate(root):
        least[x] = min(least.get(x, i), i)
    assert [got[i].component_id for i in range(len(texts))] == [least[x] for x in root]


def test_crowds_keep_every_connection(monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "CROWD", 50)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    x = np.unique(np.concatenate([b ^ np.array([sum(1 << int(k) for k in r.choice(32, r.integers(0, 5), replace=False)) for _ in range(60)], np.uint64) for b in base]))
    for own, high in ((x[(x >> np.uint64(32)) == v], True) for v in np.unique(x >> np.uint64(32))):
        pairs = simhash._forest(own, 3, high)
        index = {int(v): i for i, v in enumerate(own)}
        parent = list(range(len(own)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            for p, q in zip(a.tolist(), b.tolist()):
                assert (p ^ q).bit_count() <= 3
                parent[find(index[p])] = find(index[q])
        want = roots([int(v) for v in own])
        got = [find(i) for i in range(len(own))]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_null_ids_and_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash_components(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 7), (7, 7), (7, 7)]


def test_long_texts_are_read_in_parts(monkeypatch):
    from tessera.llm import simhash

    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcÄ") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (0, 1, 2, 3, 50, 900)]
    texts += ["  " + texts[5] + " \n", "x" * 5000, " " * 700]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        offs = np.array([0, len(data)])
        want, fp = simhash._hashes(data, offs, 3)[0], simhash.fingerprints(data, offs, 3)
        monkeypatch.setattr(simhash, "LONG", 64)
        monkeypatch.setattr(simhash, "STEP", 16)
        got, out = simhash.shingle_hashes(data, offs, 3)
        assert got.tolist() == want.tolist() and out.tolist() == [0, len(want)]
        assert simhash.fingerprints(data, offs, 3).tolist() == fp.tolist()
        monkeypatch.undo()
