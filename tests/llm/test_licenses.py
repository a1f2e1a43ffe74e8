import random

from tessera.llm.licenses import TEMPLATES, Scanner, _rising, align, scan_licenses, words


def test_rising_is_longest():
    r = random.Random(1)
    for _ in range(50):
        p = list(range(8))
        r.shuffle(p)
        best = max(bin(m).count("1") for m in range(256) if (s := [p[i] for i in range(8) if m >> i & 1]) == sorted(s))
        got = _rising(list(enumerate(p)))
        assert len(got) == best and [b for _, b in got] == sorted(b for _, b in got)


def test_align_rises_and_matches():
    r = random.Random(2)
    t = words(TEMPLATES[0][1])
    for _ in range(20):
        a = [w for w in t if r.random() > 0.1]
        pairs = align(a, t)
        assert all(a[i] == t[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) > 0.75 * len(t)


def test_every_template_is_found_and_prose_is_not(spark):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("the of license version to permission software under in and free work by river stone quiet".split()) for _ in range(n))
    rows = [(i, prose(r.randint(0, 3000)) + "\n" + text.upper() + "\n" + prose(300), "x") for i, (_, text, _, _) in enumerate(TEMPLATES)]
    rows += [(1000 + i, prose(r.randint(1, 4000)), "x") for i in range(20)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "MIT License. " * 3, "x"), (2003, "Released under the MIT License.\n" * 4, "x"), (2004, "Released under the XYZ License.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {x.doc_id: x for x in scan_licenses(df).collect()}
    assert len(got) == len(rows)
    for i, (name, text, _, _) in enumerate(TEMPLATES):
        assert name in got[i].licenses, (name, text, got[i])
        assert got[i].coverage >= 0.8
    for i in [*range(1000, 1020), 2000, 2001, 2004]:
        assert got[i].license is None and got[i].coverage == 0 and got[i].licenses == []
    assert got[2003].license == "MIT" and got[2003].coverage == 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_place_is_exact():
    s = Scanner()
    name, cover, a, b = s.scan("one two three Licensed under CC BY-NC 4.0. and more")[0]
    assert (name, cover, a, b) == ("CC-BY-NC-4.0", 1.0, 3, 8)


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_against_brute_force():
    """Every passage of every text against every template by longest common subsequences; then the same choice."""
    r = random.Random(6)
    few = [x for x in TEMPLATES if len(words(x[1])) <= 40]
    s = Scanner(few)
    for _ in range(25):
        own = []
        for _ in range(r.randint(1, 3)):
            own += [r.choice(["river", "stone", "license", "the", "of", "version", "work"]) for _ in range(r.randint(0, 12))]
            t = words(r.choice(few)[1])
            for _ in range(r.randint(0, len(t) // 12)):
                t[r.randrange(len(t))] = "other"
            own += t
        own += ["end"] * 5
        want = []
        for name, text, key, no in few:
            t, need, never = words(text), frozenset(key.split()), frozenset(no.split())
            for a in range(len(own)):
                for b in range(a + int(0.8 * len(t)), min(len(own), a + len(t) + 2) + 1):
                    p = own[a:b]
                    if p[0] in t and p[-1] in t and need <= set(p) and not never & set(p):
                        n = common(p, t)
                        if n >= 0.8 * len(t):
                            want.append((-n, b - a, name, a, b))
        kept = []
        for n, _, name, a, b in sorted(want):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((name, a, b))
        assert {x[0] for x in s.scan(" ".join(own))} == {x[0] for x in kept}, " ".join(own)


def test_a_notice_after_one_that_holds_it():
    by = {n: t for n, t, _, _ in TEMPLATES if "This work" in t and n in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0")}
    s, rest = Scanner(), " and then some quite different words. "
    for other in ("LGPL-3.0", "AGPL-3.0"):
        assert [x[0] for x in s.scan(by[other])] == [other]
        assert sorted(x[0] for x in s.scan(by[other] + rest + by["GPL-3.0"])) == sorted([other, "GPL-3.0"])
        full = next(t for n, t, _, _ in TEMPLATES if n == "GPL-3.0")
        assert s.scan(by[other] + rest + full)[0][0] in (other, "GPL-3.0") and len(s.scan(by[other] + rest + full)) == 2


def test_siblings_are_told_apart():
    """Each text alone, as it is and with a few words changed, is its own license and no other."""
    s, r = Scanner(), random.Random(7)
    for name, text, key, _ in TEMPLATES:
        t = words(text)
        for changed in (0, len(t) // 15):
            own = list(t)
            for i in r.sample([i for i, w in enumerate(t) if w not in key.split() and 0 < i < len(t) - 1], changed) if changed else ():
                own[i] = "other"
            assert [x[0] for x in s.scan("copyright 2020 " + " ".join(own) + " the end")] == [name], (name, text, changed, s.scan(" ".join(own)))


def test_numbered_and_wrapped_notices():
    s = Scanner()
    agpl = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as published\n * by the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */"
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    bsd = next(t for n, t, _, _ in TEMPLATES if n == "BSD-3-Clause").replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    gpl = agpl.replace("Affero ", "")
    for text, name in ((agpl, "AGPL-3.0"), (lgpl, "LGPL-2.1"), (bsd, "BSD-3-Clause"), (gpl, "GPL-3.0"), (gpl.replace("version 3", "version 2"), "GPL-2.0"), (lgpl.replace("2.1", "3"), "LGPL-3.0"), ("# SPDX-License-Identifier: MIT\nimport os", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0")):
        assert [x[0] for x in s.scan("Some words first.\n" + text + "\nand after")] == [name], (name, s.scan(text))


def test_repeated_words_null_ids_and_rows(spark):
    import time

    at = time.perf_counter()
    assert Scanner().scan("permission merge sublicense " * 20_000) == [] and Scanner().scan("mit " * 50_000 + "x") == []
    assert time.perf_counter() - at < 60
    rows = [(None, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0."), (2**53 + 1, "none")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((x.doc_id or 0), x.license) for x in got if x.license) == [(0, "CC-BY-4.0"), (3, "CC-BY-4.0"), (3, "CC-BY-4.0")] and {x.doc_id for x in got} == {None, 3, 2**53 + 1}
