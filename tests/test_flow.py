import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.operators import flow


# the same in plain Python, a character at a time
BULLETS = parse.BULLETS


def ends_sentence(text: str) -> bool:
    t = text.strip()
    if not re.search(r"[.!?…][\"”')\]]*$", t):
        return False
    last = t.split()[-1].lower()
    return last not in parse.ABBREVIATIONS and not re.search(r"(?:^|[\s(\[«\"'])[A-Z]\.$", t)


def starts_sentence(c: str, lang: str = "en") -> bool:
    if c in "([«\"“'" or "0" <= c <= "9":
        return True
    if lang == "es" and c in "¿¡":
        return True
    if lang == "ko" and unicodedata.name(c, "").startswith("HANGUL"):
        return True
    return "A" <= c <= "Z" if lang not in ("fr", "es", "ko") else unicodedata.category(c) == "Lu"


_CUT = re.compile(rf"""(?P<stop>[.!?…][\"”')\]]*)[ ](?=\S)|[ ](?P<item>[{BULLETS}])(?=[ ])|\[\s*(?i:PMC?ID|DOI)\b[^\[\]]*\][.;,]?(?P<id>[ ])(?=\S)""")


def sentences_of(text: str | None, lang: str = "en") -> list[str]:
    """Sentences: cut after a stop that ends one, where the next word looks like a beginning; before a list item's mark;
    after an identifier in brackets, where a sentence, a bracket or an item begins."""
    t = re.sub(r"\s+", " ", text or "").strip()
    out, start = [], 0
    at = 0
    while m := _CUT.search(t, at):
        at = m.end() - bool(m["item"])
        if m["item"]:
            end, after = m.start(), m.start() + 1
        else:
            end, after = (m.end() - 1, m.end()) if m["stop"] else (m.start("id"), m.end())
            nxt = t[after]
            if m["stop"]:
                good = starts_sentence(nxt, lang) and ends_sentence(t[max(start, end - 80) : end]) and not (nxt in "¿¡" and t[after + 1 : after + 2].islower())
            else:
                good = starts_sentence(nxt, lang) or nxt == "[" or nxt in BULLETS
            if not good:
                at = m.start() + 1 if not m["stop"] else m.end() - 1
                continue
        if end > start:
            out.append(t[start:end].strip())
            start = after
    return [x for x in [*out, t[start:].strip()] if x]


def test_sentences():
    s = sentences_of
    assert s('He came, e.g. Smith et al. He left. "Why?" J. Doe asked... and went.  New line.') == ["He came, e.g. Smith et al. He left.", '"Why?"', "J. Doe asked... and went.", "New line."]
    assert s("Vino. ¿Qué? ¿Sí? no.", "es") == ["Vino.", "¿Qué?", "¿Sí? no."]
    assert s("Fin. École ouverte. été.", "fr") == ["Fin.", "École ouverte. été."] and s("Fin. École.", "en") == ["Fin. École."]
    assert s(None) == [] and s("  ") == [] and s("x" * 20000) == ["x" * 20000]
    t = "The end. " * 3000
    assert len(s(t)) == 3000


def test_items_identifiers_and_units():
    s = sentences_of
    assert s("Give 5 mg. Then wait.") == ["Give 5 mg. Then wait."]
    assert s("All • one • two. End [PMID: 1], Next [DOI 2] and") == ["All", "• one", "• two.", "End [PMID: 1],", "Next [DOI 2] and"]


def test_sentences_lose_nothing():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("Ab .!?…\"') ") for _ in range(80))
        assert "".join(sentences_of(t)).replace(" ", "") == t.replace(" ", "")


def test_sentences_equal_plain_python(spark):
    r = random.Random(4)
    words = ["a", "B", "et", "al.", "e.g.", "J.", "mg.", "end.", "End!", "so?)", 'x."', "¿No", "¿no", "É.", "été.", "가다.", "나", "[PMID: 1]", "[DOI 2].", "•", "3", "…", "(A", "’", "p.", "No.", "École"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 25))), r.choice(["en", "fr", "es", "ko", "de", None])) for i in range(1500)]
    got = spark.createDataFrame(rows, "i int, t string, g string").select("i", parse.sentences(F.col("t"), F.col("g")).alias("s")).collect()
    for x in got:
        _, t, g = rows[x.i]
        assert x.s == sentences_of(t, g or "en"), (t, g)


def test_json():
    j = parse.repair_json
    assert j('{"a": 1}') == ({"a": 1}, [])
    assert j('Sure:\n```json\n{"a": [1, 2,], // x\n "b": “q”}\n```')[0] == {"a": [1, 2], "b": "q"}
    assert j('{"a": [1, {"b": "x y"}, {"c": "un')[0] == {"a": [1, {"b": "x y"}, {"c": "un"}]}
    assert j('[{"a": 1}, {"b":')[0] == [{"a": 1}, {"b": None}] or j('[{"a": 1}, {"b":')[0][0] == {"a": 1}
    assert j("no") == (None, ["failed"]) and j(None) == (None, ["failed"])
    assert j('{"a": "/* not */ // one", "b": 2,}') == ({"a": "/* not */ // one", "b": 2}, ["commas"])
    full = json.dumps({"items": [{"id": i, "t": "x,y: z"} for i in range(5)]})
    for n in range(1, len(full)):
        v, done = j(full[:n])
        assert v is None or isinstance(v, dict)


def test_evidence():
    h = parse.holds
    assert h("It was “10–20 %” of all", '"10-20 %" of') == "exact"
    assert h("the heart, which (often) fails", "the heart which often fails") == "loose"
    assert h("catalogue", "cat") is None and h("a cat.", "cat") == "exact" and h("x", "") is None
    assert h("value 2.5 mg", "value 25 mg") is None


def test_lines_and_chunks(spark):
    rows = [("a", ["methicillin-", "resistant bug", "inter-", "national", "car-", " dio ", "", "2019-", "x", "End-", "Of"]), ("b", []), ("c", ["one"]), ("d", ["angiotensin-", "converting enzyme", "cardio-", "vascular  x-", "", "y"])]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k string, l array<string>").select("k", flow.join_lines(F.col("l")).alias("t")).collect()}
    assert got == {"a": "methicillin-resistant bug inter-national cardio 2019- x End- Of", "b": "", "c": "one", "d": "angiotensin-converting enzyme cardiovascular x-y"}
    r = random.Random(3)
    data = [(k, i, r.randint(1, 50)) for k in range(5) for i in range(60)] + [(9, 0, 500), (9, 1, 1)]
    out = flow.chunks(spark.createDataFrame(data, "k int, i int, n int"), "k", ["i"], "n", 100, 4).collect()
    for k in {x[0] for x in data}:
        total, n, c = 0, 0, 0
        for x in sorted(y for y in out if y.k == k):
            if n and (total + x.n > 100 or n >= 4):
                total, n, c = 0, 0, c + 1
            total, n = total + x.n, n + 1
            assert x.chunk == c


def test_spread_and_grades(spark):
    df = spark.createDataFrame([(0, p, i, 1 if p == 2 else 0) for p in range(1, 6) for i in range(2)], "g int, page int, i int, load int")
    order = [(r.page, r.i) for r in flow.spread(df, "g", "page", "load", "i").orderBy("turn").collect()]
    assert [p for p, _ in order] == [1, 5, 3, 4, 2] * 2 and [i for _, i in order] == [0] * 5 + [1] * 5
    g = spark.createDataFrame([(["A", "B"], ["B", "A"]), (["A"], ["A", "B"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in g.select(flow.grade_sets(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_running_totals_by_blocks(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 40)) for i in r.sample(range(-500, 5000), 900)]
    df = spark.createDataFrame(rows, "k string, i long, n int")
    for down in (False, True):
        want = {}
        for k in ("a", "b", None):
            total = 0
            for _, i, n in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1] if down else x[1]):
                if total < 1500:
                    want[k, i] = total
                total += n
        got = {(x.k, x.i): x.before for x in flow.running(df, "k", "i", "n", 1500, down, 70).collect()}
        assert got == want


@pytest.mark.parametrize("rows,most,items", [(1, 10, 0), (3, 10, 4), (4, 50, 0), (7, 50, 3), (4096, 50, 5), (5, 0, 0), (2, 1000, 0)])
def test_chunks_by_blocks_are_those_of_a_loop(spark, rows, most, items):
    r = random.Random(rows * 31 + most)
    data = [(k, i, r.choice([0, 1, 3, 9, 10, 11, r.randrange(70), None]), "x") for k, n in (("a", 200), ("b", 1), ("c", 37)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i int, size int, sums string").repartition(4)
    got = {(x.k, x.i): x.chunk for x in flow.chunks(df, "k", ["i"], "size", most, items, rows).collect()}
    want, now = {}, None
    for k, i, s, _ in data:
        s = s or 0
        if k != now:
            now, total, n, chunk = k, 0, 0, 0
        elif total + s > most or items and n >= items:
            total, n, chunk = 0, 0, chunk + 1
        total, n = total + s, n + 1
        want[k, i] = chunk
    assert got == want
    assert flow.chunks(df.limit(0), "k", ["i"], "size", most, items).count() == 0
