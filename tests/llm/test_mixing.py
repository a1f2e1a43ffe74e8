from collections import Counter
import random
from collections import defaultdict

import pytest

from tessera.llm.mixing import mix_digest, mixed


def water(sizes):
    """Targets by repeated resharing, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    got, full = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        got = {s: 3 * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return got
        full |= over


def made(seed, n=1500):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.35 else r.choice([None, "", "a", "B", "é", "zz", "none"])
        k = 0 if s == "none" else r.choice([0, 1, 3, 50, 120, r.randint(1, 400)])
        rows.append((i, None if r.random() < 0.02 else r.choice([" ", "\n", "\x0b"]).join(["w\u00a0x"] * k), s, "extra"))
    return rows + rows[:20]


def test_targets_and_totals(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix_digest(df.repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = {i: len((t or "").split()) // 1 for i, t, _, _ in rows}
    # a no-break space does not part words here
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for i, _, s, _ in rows:
        total[s] += size[i]
    want = water(dict(total))
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, x in want.items():
        assert abs(taken[s] - x) <= 0.02 * x + 400, (s, taken[s], x)
    again = mix_digest(df.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixed_rows(spark):
    df = spark.createDataFrame(made(2, 300), "doc_id long, text string, source string, copies string")
    out = mixed(df)
    assert out.columns == df.columns and out.count() > 0
    assert mixed(df.limit(0)).count() == 0 and mix_digest(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mix_digest(empty).collect()] == [0, 0]


def test_rows_that_share_id_and_size_are_taken_alike_on_reruns(spark):
    from tessera.llm.mixing import mixed

    rows = [(i % 7, f"{w} {i} x", "a" if i % 3 else "b") for i in range(400) for w in ("p", "q")] + [(None, None, None), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two, three = (sorted(map(repr, mixed(x).collect())) for x in (df, df.repartition(7), df.orderBy("text").coalesce(1)))
    assert one == two == three and len(one) > 0


def h64(*parts):
    """Spark's xxhash64 of ints, longs and strings; a null does not count."""
    import struct

    import xxhash

    h = 42
    for kind, x in parts:
        if x is not None:
            h = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def test_taken_by_brute_force(spark):
    """Each source's documents in one list, a step for each, and a document wherever a step crosses a whole number."""
    import math
    import random
    import re

    from tessera.llm import mixing

    r = random.Random(12)
    rows = [(r.choice([None, i, i - 5000]), r.choice([None, "", " ", *[" ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 400))) for _ in range(6)]]), r.choice(["a", "b", "c", None, "d"] if i > 300 else ["a", "e"])) for i in range(900)]
    rows.append((10**12, " ".join("z" for _ in range(30_000)), "b"))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(n for n, x in zip(size, rows) if x[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = sum(total.values()) - sum(target.values())
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * total[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            open_.remove(s)
    got = Counter((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect())
    want = Counter()
    for s in sources:
        own = []
        for (i, t, x), n in zip(rows, size):
            if x == s:
                dice = h64(("i", 17), ("q", i))
                up, step = (dice % (1 << 64) >> 40) % 2 == 0, math.floor(8 * math.log2(n + 1))
                kind = step if up else mixing.TURN - step
                own.append((kind, dice % 64, n if kind < mixing.TURN // 2 else -n, dice, (i is not None, i), (t is not None, h64(("s", t))), i, n))
        rate = target[s] / total[s] if total[s] else 0.0
        off = h64(("i", 17), ("s", "\u0000" if s is None else s)) % (1 << 30) / (1 << 30)
        for k, x in enumerate(sorted(own), 1):
            copies = min(3, math.floor(k * rate + off) - math.floor((k - 1) * rate + off))
            want[x[-2], x[-1], total[s], round(target[s], 6), copies * x[-1]] += 1
    assert got == want
