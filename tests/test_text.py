import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates, hashing
from tessera.functions import text as T
from tessera.operators import search


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_fold_keeps_length(s):
    assert len("".join(map(T.fold_char, s))) == len(s)


def test_fold_column_equals_the_rule(spark):
    s = ["Été — L’ÂGE", "ＡＢＣ　１", "İstanbul ﬁ ㎎", "naïve–co-op “x” ‘y’", "Straße Ωmega ё", "日本 한국 á"]
    got = [r.f for r in spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i int, t string").orderBy("i").select(T.fold(F.col("t")).alias("f")).collect()]
    assert got == ["".join(map(T.fold_char, x)) for x in s]
    assert got[0] == "ete   l'age" and got[1] == "abc 1" and got[2].startswith("İ")


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_scalar_rules(spark):
    t = F.col("t")
    assert one(spark, "AIza" + "x" * 35 + " Bearer tok sk-" + "a" * 20 + " AQ." + "b" * 25, T.redact(t))[0] == "[KEY] [KEY] [KEY] [KEY]"
    assert one(spark, "my secret-long secret", T.redact(t, ["secret", "secret-long"]))[0] == "my [KEY] [KEY]"
    assert one(spark, "한국어 글자", T.estimate_tokens(t))[0] == 3 and one(spark, "abcde", T.estimate_tokens(t))[0] == 2 and one(spark, "", T.estimate_tokens(t))[0] == 0
    assert [one(spark, x, T.csv_cell(t))[0] for x in ("=1+1", "''-x", 'a"b', "plain", None)] == ["'=1+1", "'''-x", '"a""b"', "plain", ""]
    assert one(spark, "1,500 and ٣٫٥ 007 2.50 1,2", T.number_tokens(t))[0] == ["1", "1500", "2", "2.5", "3.5", "7"]
    assert [one(spark, x, T.parse_number(t))[0] for x in (" 1,234.5% ", "-.5", "1e3", "x", "1..2", None)] == [1234.5, -0.5, 1000.0, None, None, None]
    assert one(spark, " DF.Groupby（'a'）()() ", T.normal_answer(t))[0] == "df.groupby(a)"
    assert [one(spark, str(x), T.round_half_up(t.cast("double"), 0))[0] for x in (-2.5, 2.5, -2.6)] == [-2.0, 3.0, -3.0]
    assert one(spark, "a� b\x01", *T.garble(t))[:] == (5, 3)
    assert one(spark, "## Hi [x](u) `c`\n\nnext", T.excerpt(t))[0] == "Hi x c"
    assert one(spark, "a b&c", T.fill_query(F.lit("https://h/?q={q}"), t))[0] == "https://h/?q=a%20b%26c"
    assert [one(spark, x, T.safe_link(t))[0] for x in (None, "http://a", "https://u@a/", "https://a/" + "x" * 3000, "https://a")] == ["empty", "scheme", "userinfo", "long", "ok"]
    assert one(spark, "Page 12  of 9", T.repeat_key(t))[0] == "page # of #"


@pytest.mark.parametrize("text,want", [("그는 오늘 학교에 갔다. " * 30, "ko"), ("これは日本語の文章です。" * 30, "ja"), ("这是一个中文句子测试" * 30, "zh"), ("هذا نص عربي طويل جدا " * 20, "ar"), ("the cat and the dog of the town is in the house. " * 8, "en"), ("le chat et la maison des amis est dans une rue du nord. " * 8, "fr"), ("Los pacientes con una fiebre por las noches del mes para el estudio. " * 8, "es"), ("short text", "en")])
def test_language(spark, text, want):
    r = T.with_language(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r.guess == want and 0 <= r.score <= 1


def test_hashes(spark):
    vectors = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    rows = spark.createDataFrame([(k,) for k in [*vectors, None, "é" * 50]], "t string").select("t", hashing.fnv1a64("t").alias("h"), hashing.hash_form(F.col("t")).alias("n")).collect()
    for r in rows:
        if r.t in vectors:
            assert r.h == vectors[r.t]
        elif r.t:
            h = 0xCBF29CE484222325
            for b in r.t.encode():
                h = (h ^ b) * 0x100000001B3 % 2**64
            assert r.h == f"{h:016x}"
        else:
            assert r.h is None
    assert one(spark, " ㎎  x\n", hashing.hash_form(F.col("t")))[0] == unicodedata.normalize("NFKC", "㎎") + " x"


def test_dates(spark):
    t = F.col("t")
    assert [one(spark, x, dates.day_number(t))[0] for x in ("1970-01-02", "2024-02-29", "2023-02-29", "2024-1-1", None)] == [1, 19782, None, None, None]
    assert one(spark, "x", dates.day_key(F.lit(19782)), dates.weekday(F.lit(0)))[:] == ("2024-02-29", 4)
    assert [one(spark, x, dates.time_ms(t))[0] for x in ("12", "1970-01-01T00:00:01Z", "no")] == [12, 1000, None]
    assert [one(spark, str(x), *dates.span(t.cast("long")))[:] for x in (1, 7200000, 86400000 * 3, 86400000 * 60, 86400000 * 400)] == [(1, "min"), (2, "hour"), (3, "day"), (2, "month"), (1.1, "year")]
    for a, n in ((0, 30), (3, 11), (5, 1), (6, 0)):
        want = max(0, sum((x + 4) % 7 in (1, 3, 5) for x in range(a, a + n)) - 1)
        assert one(spark, "x", dates.study_days(F.lit(a), F.lit(a + n), [1, 3, 5], 1))[0] == want


def test_queries():
    assert search.parse("a").error == "short" and search.parse("x" * 61).error == "long" and search.parse("--").error == "short"
    q = search.parse("DNA")
    assert q.cased and q.whole and q.variants == ("DNA",)
    assert "α blocker" in search.parse("alpha-blocker").variants
    assert set(search.parse("antiviral").variants) == {"antiviral", "anti viral"}
    assert search.parse("東").open and not search.parse("病院").whole
    assert search.find("the other the", search.parse("the")) == [(0, 3), (10, 3)]
    assert search.find("cardio anti viral", search.parse("antiviral")) == [(7, 10)]


def test_hits_and_snippets(spark):
    docs = spark.createDataFrame([(1, "Ünïted fronts\nare the Fronts of frontsmen; un-fronts"), (2, "none"), (3, None), (4, "fronts " * 1200)], "doc_id long, text string")
    found = search.hits(docs, "FRONTS OF"[:6].lower())
    assert found.where("doc_id = 4").count() == search.HITS and search.groups(found).where("doc_id = 4").first().truncated
    assert [(r.at, r.len) for r in found.where("doc_id = 1").orderBy("at").collect()] == [(7, 6), (22, 6), (32, 6), (46, 6)]
    text = docs.where("doc_id = 1").first().text
    s = found.where("doc_id = 1").join(docs, "doc_id").select("at", search.snippet(F.col("text"), F.col("at"), F.col("len"), 5).alias("s")).orderBy("at").collect()
    assert [r.s for r in s][:2] == ["Ünïted [fronts]", "are the [Fronts] of frontsmen"] and text[22:28] == "Fronts"
    assert search.hits(docs, "x").count() == 0
    assert np.array([1]).sum() == 1


def test_plain_texts_do_not_go_to_python(spark):
    from tessera.functions import hashing

    rows = [("a  b\t", "a b"), ("ﬁn ½", "fin 1⁄2"), (None, None), ("", ""), ("é ", "é")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", hashing.hash_form(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    assert "nfkc(CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()


def test_found_function_words_are_those_of_all_words(spark):
    """every word of a text became a row of an array and was lowered four times."""
    r = random.Random(25)
    parts = ["el", "El", "EL", "eL", "Los", "LOs", "LOS", "la", "La", "the", "The", "THE", "foreign", "lo", "Lo", "una", "İel", "elé", "Él", "Ⅻ", "casa", "Casa", "x", "por", "ſ", "del", "K", "인", "و", "le", "Est", "et", "𝒜el", "é", "él"]
    rows = [("".join(r.choice(parts) + r.choice([" ", " ", "-", "' ", ". 7 ", "\n", "1", ""]) for _ in range(r.randrange(30))),) for _ in range(400)]
    d = spark.createDataFrame(rows, "t string").withColumn("w", T.letter_words(F.col("t"))).withColumn("f", T.found_words(F.col("t")))
    all_, found = T.function_words(F.col("w")), T.found_function_words(F.col("t"), F.col("f"))
    got = d.select("t", *[all_[k].alias(f"a_{k}") for k in found], *[found[k].alias(f"f_{k}") for k in found]).collect()
    assert [x for x in got if any(x[f"a_{k}"] != x[f"f_{k}"] for k in found)] == []
    assert sum(x.f_es for x in got) > 100


def test_language_takes_no_word_but_function_words(spark):
    d = T.with_language(spark.createDataFrame([("x",)], "t string"), "t")
    assert "\\p{L}+, 0" not in d._jdf.queryExecution().optimizedPlan().toString()
