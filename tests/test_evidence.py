import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.forms import loose, normal, place
from tessera.operators import evidence


def test_forms_keep_where_characters_come_from():
    t = "  The ﬁrst ½ of “exam-\n  ple” – 5­0 %!\n"
    f = normal(t)
    assert f.text == 'The first 1⁄2 of "example" - 50 %!'
    for i, c in enumerate(f.text):
        own = t[f.starts[i] : f.ends[i]]
        assert f.ends[i] == f.starts[i] + 1 and (c in normal(own).text or own.isspace() or c in "\"-")
    assert loose(f).text == "The first 1⁄2 of example 50 !".replace("⁄", loose(normal("1⁄2")).text[1])
    assert normal("well-\nKnown a-\n1 b - \nc").text == "well- Known a- 1 b - c"
    assert loose(normal("a 7.5 mg, -3 (x) 40% .5 1,500: 3-4?")).text == "a 7.5 mg -3 x 40% .5 1,500 3-4?"
    assert normal("").text == "" and normal(" ­").text == ""


@pytest.mark.parametrize(
    "text,quote,how,got",
    [("A «big» ﬁsh.", '"big" fish', "exact", "«big» ﬁsh"), ("It is, so-called, new", "is so called new", None, None), ("It is, (so) new", "is so new", "loose", "is, (so) new"), ("ineffective here", "effective here", "inside", None), ("x effective; ineffective", "effective", "exact", "effective"), ("painless", "pain", "inside", None), ("310 a", "3 10 a", None, None), ("a", None, None, None), ("what?", "what", "exact", "what")],
)
def test_places(text, quote, how, got):
    h, a, b = place(text, quote)
    assert h == how and (text[a:b] if a is not None else None) == got


def test_every_quote_maps_back_to_its_text(spark):
    r = random.Random(5)
    words = "The ﬁrst ﬂow of “quoted” text – 5½ mg/kg, isn’t it? naïve ｗｉｄｅ x² 10⁹ (a) non­stop".split(" ")
    paras = [(i, i, " ".join(r.choice(words) for _ in range(40)).replace(" ", "  ", 2)) for i in range(40)]
    quotes = []
    for i, _, t in paras:
        w = t.split(" ")
        a = r.randrange(len(w) - 9)
        quotes.append((i, normal(" ".join(w[a : a + r.randint(1, 9)])).text, r.choice([None, i, 3])))
    quotes += [(100, "nowhere to be found", None), (101, "", None), (102, None, 1)]
    p = spark.createDataFrame(paras + [(50, 50, None)], "para int, seq int, text string")
    q = spark.createDataFrame(quotes, "quote_id int, quote string, claimed int")
    got = {(x.para, x.quote_id): (x.how, x.start, x.end) for x in evidence.places(p, q).collect()}
    want = {(i, k): place(t, x) for i, _, t in paras for k, x, _ in quotes}
    want = {k: v for k, v in want.items() if v[0] in ("exact", "loose")}
    assert got == want
    text, asked = {i: t for i, _, t in paras}, {k: x for k, x, _ in quotes}
    for (i, k), (how, a, b) in got.items():
        form = normal if how == "exact" else lambda x: loose(normal(x))
        assert form(text[i][a:b]).text == form(asked[k]).text
    best = {x.quote_id: (x.para, x.how) for x in evidence.found(p, q).collect()}
    for k, _, claimed in quotes:
        own = sorted((v[0] == "loose", i != claimed, i) for (i, j), v in want.items() if j == k)
        assert best.get(k) == ((own[0][2], "loose" if own[0][0] else "exact") if own else None)


def test_a_batch_keeps_the_forms_alone():
    import tracemalloc

    import pandas as pd

    from tessera.functions.forms import forms

    texts = pd.Series(["The quoted text of a page. " * 80] * 300)
    tracemalloc.start()
    forms.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 << 20  # places of all characters would take some 50 MB


def test_forms_without_places_are_the_same():
    from tessera.functions.forms import loose_text, normal_text

    r = random.Random(6)
    marks = "ab e1 2 5%‰+-±.,?!\n\t ‐\u00ad½ﬁ“”‘″‴¨_xÉ፩²೨/()°éA B\u3000ｍ\x85\u0301😀\u2033"
    for _ in range(3000):
        t = "".join(r.choice(marks) for _ in range(r.randint(0, 30)))
        f = normal(t)
        assert (f.text, loose(f).text) == (normal_text(t), loose_text(normal_text(t))), t


def test_forms_are_made_once_and_texts_are_not_joined_again(spark):
    """a text's forms were made for each way of looking it up, and texts were shuffled to meet their quotes again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    p = spark.createDataFrame([(1, "It is - as we (said) in ½ of them - so."), (2, "none"), (3, None)], "para int, text string").withColumn("text", counted("text"))
    q = spark.createDataFrame([(1, "as we (said) in ½ of"), (2, "as we said in ½ of"), (3, "said"), (4, "—"), (5, "so it is")], "quote_id int, quote string")
    got = sorted((x.para, x.quote_id, x.how) for x in evidence.places(p, q.where("quote_id < 3")).collect())
    assert got == [(1, 1, "exact"), (1, 2, "loose")] and made.value == 3
    assert sorted((x.quote_id, x.how) for x in evidence.places(p, q).collect()) == [(1, "exact"), (2, "loose"), (3, "exact"), (4, "exact")]
