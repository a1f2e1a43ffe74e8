import hashlib
import random
import struct

import pytest
import regex
import xxhash

from tessera.llm import syncmers
from tessera.llm.syncmers import anchors, fingerprint_digest


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 6)))
    return [None, "", "a", "ab", "abc", "one two three four", "x" * 3000] + [f"v{i} w{i} x{i} y{i} z{i}" for i in range(12)] + [" ".join(word() for _ in range(r.randint(5, 300))) for _ in range(n)]


@pytest.mark.parametrize("rows", [500, 7])
def test_edits_and_likeness(spark, monkeypatch, rows):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", rows)
    texts = made(1)
    ids = random.Random(2).sample(range(-100, 10**12), len(texts))
    df = spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, part string").repartition(4)
    got = {r.doc_id: r for r in fingerprint_digest(df).collect()}
    assert len(got) == len(texts)
    text = {i: t or "" for i, t in zip(ids, texts)}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) > 400 and len(nxt) > 400:
            assert r.near_edited > 0.25 and r.near_next < 0.1
        assert (r.near_edited == 1) >= (e == t)


def test_equal_texts_and_context(spark):
    r = random.Random(5)
    w = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    mid = w(200)
    df = spark.createDataFrame([(1, mid), (2, mid), (3, w(50) + " " + mid + " " + w(50)), (None, "tail"), (None, None)], "doc_id long, text string")
    rows = {x.doc_id: x for x in fingerprint_digest(df).collect() if x.doc_id}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[2].near_next == 1
    a = anchors(df).toPandas()
    own = set(a[a.doc_id == 1].anchor)
    assert own <= set(a[a.doc_id == 3].anchor)  # no context: a passage's anchors stay
    shift = {(x.at + 50, x.anchor) for x in a[a.doc_id == 1].itertuples()}
    assert shift <= {(x.at, x.anchor) for x in a[a.doc_id == 3].itertuples()}
    assert fingerprint_digest(df.limit(0)).count() == 0


def h64(*parts):
    """Spark's xxhash64 of strings and longs."""
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def brute(text):
    """(anchors, digest) of a text, a k-mer at a time."""
    pattern = regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), syncmers.LETTER)
    w = [h64(x) for x in regex.findall(pattern, text or "")]
    found = set()
    for i in range(len(w) - 4):
        pairs = [h64(w[i + j], w[i + j + 1]) for j in range(4)]
        if min(pairs) in (pairs[0], pairs[3]):
            found.add(h64(pairs[0], pairs[2], pairs[3]))
    if not found:
        found = {h64(*w)}
    return found, "".join(f"{x:08x}" for x in sorted({a & 0xFFFFFFFF for a in found})[:64])


def test_against_brute_force(spark):
    r = random.Random(9)
    texts = made(3, 25) + ["".join(r.choice("日本語漢字かなカナ中文") for _ in range(300)), "北京 is " + "大学" * 40, "".join(r.choice("abcdef") for _ in range(700)), "a\u00a0b c", "x" * 24, "x" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in fingerprint_digest(df).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        own, edited, other = brute(t), brute(e), brute(nxt)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own[1], edited[1]), (i, t[:80])
        like = lambda a, b: len(a & b) / len(a | b)
        assert got[i].near_edited == pytest.approx(like(own[0], edited[0])) and got[i].near_next == pytest.approx(like(own[0], other[0]))


def test_unspaced_passages_keep_their_anchors(spark):
    r = random.Random(10)
    mid = "".join(r.choice("日本語漢字かなカナ中文学校") for _ in range(400))
    blob = "".join(r.choice("abcdefghij") for _ in range(400))
    df = spark.createDataFrame([(1, mid), (2, "序言" + mid + "了"), (3, blob), (4, "qrs" + blob + " end")], "doc_id long, text string")
    a = anchors(df).toPandas()
    of = lambda i: set(a[a.doc_id == i].anchor)
    assert of(1) <= of(2) and len(of(3) & of(4)) > 0.85 * len(of(3))


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 5)
    texts = made(4, 40)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, f int").repartition(5)
    one, two = (sorted(map(repr, fingerprint_digest(x).collect())) for x in (df, df.repartition(2)))
    assert len(one) == len(rows) and one == two
