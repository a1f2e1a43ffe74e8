import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm.repeats import measure_repeats, strip_repeats


def brute(texts, least=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        cov = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if n[b[i : i + least]] > 1:
                cov[i : i + least] = b"\1" * least
        kept = bytes(x for x, c in zip(b, cov) if not c)
        spans = sum(1 for i in range(len(b)) if cov[i] and (i == 0 or not cov[i - 1]))
        out.append((len(b), sum(cov), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    w = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    shared = [w(r.randint(150, 900)) for _ in range(6)]
    texts = [None, "", "x", "a" * 1500, "ab" * 400, "a" * 199, "a" * 200, w(3000) + "é" * 300]
    for _ in range(60):
        t = w(r.randint(0, 500))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            t += s[a : r.randint(a, len(s))] + w(r.randint(0, 250))
        texts.append(t)
    for t in texts[10:25]:
        texts.append(t)
        x = list(t)
        for _ in range(3):
            if x:
                x[r.randrange(len(x))] = "#"
        texts.append("".join(x))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = made(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, batch string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in measure_repeats(df).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, (i, got[i], want)


def test_strip_keeps_rows_columns_and_characters(spark):
    texts = made(3)
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, body string")
    out = strip_repeats(df)
    assert out.schema == df.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts) and rows[0].text is None
    for i, (n, gone, _, digest) in enumerate(brute(texts)):
        t = rows[i].text or ""
        assert rows[i].n_chars == len(t)
        if "é" not in (texts[i] or ""):
            assert hashlib.sha256(t.encode()).hexdigest() == digest
        else:
            assert n - gone <= len(t.encode()) <= n


def test_empty_table(spark):
    assert measure_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "b" * 300, 1), (1, "b" * 300, 1)], "doc_id long, text string, r int")
    assert [r.n_removed for r in measure_repeats(same).collect()] == [300, 300]


@pytest.mark.parametrize("n", [201, 300, 368, 400])
def test_lone_periodic_texts(spark, n):
    r = random.Random(n)
    noise = lambda k: "".join(r.choice("defgijklmnop") for _ in range(k))
    units = ["a", "ab", "ha ", "-=", "x" * 31 + "y", "the same line over and over, about sixty bytes long, again.\n", "é"]
    alone = [(u * 400).encode()[:n].decode(errors="ignore") for u in units]
    for texts in (alone + [noise(700)], [noise(300) + t + noise(300) for t in alone]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        got = {x.doc_id: tuple(x)[1:] for x in measure_repeats(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_windows_and_checks(monkeypatch):
    from tessera.llm import repeats

    r = random.Random(8)
    t = "".join(r.choice("abé ") for _ in range(4000)) + "xy" * 700 + "".join(r.choice("abé ") for _ in range(1500))
    data = np.frombuffer((t + t[200:900]).encode(), np.uint8)
    offs = np.array([0, len(data)])
    whole = repeats.Runs(data, offs, 200)
    covered = lambda x: np.concatenate([np.arange(a, b + 1) for a, b in zip(x.first, x.last)])
    want = dict(zip(*[np.concatenate(c).tolist() for c in list(zip(*repeats._starts(data, whole.first, whole.last, 200)))[:2]]))
    monkeypatch.setattr(repeats, "LONG", 700)
    parts = repeats.Runs(data, offs, 200)
    assert covered(parts).tolist() == covered(whole).tolist() == list(range(len(data) - 199))
    got = list(repeats._starts(data, parts.first, parts.last, 200))
    assert len(got) > 5 and dict(zip(*[np.concatenate(c).tolist() for c in list(zip(*got))[:2]])) == want
    # one name by chance for two strings: the check tells them apart
    x = np.array([(7, 1, 0), (5, 3, 0), (7, 2, 0), (7, 1, 1), (5, 3, 0)], repeats.NAME)
    inv, first, n = repeats._same(x)
    assert n[inv].tolist() == [2, 2, 1, 2, 2] and inv[0] == inv[3] != inv[2] and sorted(first.tolist()) == [0, 1, 2]
    assert repeats._same(x[[0, 1, 3]])[2].tolist() == [1, 2]


def test_a_long_text_and_null_ids(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    t = " ".join(word() for _ in range(330_000))
    assert len(t) > 5 << 19
    texts = [t, t[1_000_000:1_000_500], "z" + t[-400:], word()]
    df = spark.createDataFrame([(None if i == 1 else i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_removed for x in measure_repeats(df).collect()}
    assert got == {0: 900, None: 500, 2: 400, 3: 0}
