import numpy as np

from tessera.llm.quality import fit, fit_rules, prepared, quality


def test_rules_find_a_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    m = fit_rules(list("abcd"), x, y)
    assert 0 < len(m.rules) <= 60
    s = np.full(len(y), m.bias)
    for k in m.rules:
        hit = np.ones(len(y), bool)
        for name, bound, upto in k.terms:
            v = x[:, "abcd".index(name)]
            hit &= v <= bound if upto else v > bound
        s += k.weight * hit
    assert np.mean((s > 0) == (y > 0.5)) > 0.97


def test_held_out_accuracy(spark, small):
    base = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_l"))
    held = out[out.held_out]
    assert len(held) > 60 and out.score.between(0, 1).all() and ((out.score >= 0.5) == out.predicted).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None]))
    assert auc > 0.9 and np.mean(held.predicted == held.quality) > 0.9, (auc, np.mean(held.predicted == held.quality))


def test_labels_of_held_out_rows_do_not_count(spark, small):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.expr("IF(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality)"))
    assert fit(docs, labels) == fit(docs, flipped)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x" * 5000, 0.5), (3, "a b", 0.5), (3, "a b", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality(docs, none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    one = spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, quality int")
    assert quality(docs, one).count() == 5 and quality(docs.limit(0), one).count() == 0
    assert prepared(docs).columns[0] == "row"


def by_hand(text):
    """The statistics of a text in plain Python."""
    import math

    import regex

    from tessera.llm.quality import STOP

    t = text or ""
    w, lines = regex.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    n, k = max(len(t), 1.0), max(len(w), 1.0)
    count = lambda p: len(regex.findall(p, t, flags=regex.VERSION0))
    stop = set(STOP.split())
    return {
        "s_words": math.log1p(len(w)), "s_word_length": len(t) / k, "s_upper": count(r"\p{Lu}") / n, "s_digits": count(r"\p{Nd}") / n,
        "s_signs": sum(not regex.match(r"[\p{L}\p{N} \t\n\x0b\f\r]", c) for c in t) / n, "s_marks": count(r"[#$%&*@^~<>{}\\=+]") / n, "s_shouts": count(r"[!?]") / k, "s_bars": t.count("|") / k,
        "s_ends": count(r"[.!?](?:[ \t\n\x0b\f\r]|\Z|(?=\n\Z))") / k, "s_stops": sum(x.lower() in stop for x in w) / k, "s_distinct": len(set(w)) / k, "s_same_lines": 1 - len(set(lines)) / max(len(lines), 1.0),
        "s_line_words": k / max(len(lines), 1.0), "s_links": count(r"https?://|www\.") / k,
    }


def test_scores_by_hand(spark, small):
    import math

    from tessera.llm.quality import scored

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    odd = [None, "", " ", "a", "WWW. http://x www.y.z", "Ünï ÉÀ 12３ !?", "x|y|z\n\nx|y|z", "the the der\nthe the der\n", "End. End.\n", "日本語。 ok!", "#$%&*@^~<>{}\\=+"]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    model = fit(docs, labels)
    assert len(model.rules) > 0
    every = docs.select("doc_id", "text").unionByName(more)
    for r in scored(every, model).select("row.doc_id", "row.text", "score").collect():
        v = by_hand(r.text)
        total = model.bias + sum(k.weight for k in model.rules if all(v[n] <= b if upto else v[n] > b for n, b, upto in k.terms))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9, (r.doc_id, r.text and r.text[:80])


def test_one_real_text_of_those_that_share_an_id(spark):
    from tessera.llm.quality import prepared

    texts = ["a b c d", "!!! ??? ###"]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(60)] + [(i, texts[1 - i % 2]) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id long, quality int")
    assert fit(docs, labels) == fit(docs.repartition(7), labels) and prepared(docs).count() == 120
