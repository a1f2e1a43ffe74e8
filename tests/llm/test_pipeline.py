import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.common import read


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.fixture(scope="module")
def steps(spark, small):
    from tessera.llm.common import Saved

    docs = read(spark, small, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(Saved(f(spark, out[-1], small)).df)
    return out


def test_columns_stay(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mix", "pack"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.count() > 0


def test_quality_is_the_classifier(spark, small, steps):
    from tessera.llm.quality import quality

    want = {r.doc_id for r in quality(steps[0], read(spark, small, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_near_copies_by_brute_force(steps):
    rows = {r.doc_id: shingles(r.text) for r in steps[1].select("doc_id", "text").collect()}
    left = {r.doc_id for r in steps[2].collect()}
    j = lambda a, b: len(rows[a] & rows[b]) / len(rows[a] | rows[b])
    ids = sorted(rows)
    assert not [(a, b) for a in left for b in left if a < b and j(a, b) >= 0.85]
    for i in ids:
        if i not in left:
            assert max(j(i, k) for k in ids if k != i) >= 0.74


def test_repeats_by_brute_force(steps):
    rows = {r.doc_id: (r.text or "").encode() for r in steps[2].select("doc_id", "text").collect()}
    n = Counter(b[i : i + 200] for b in rows.values() for i in range(len(b) - 199))
    left = {r.doc_id: r.text for r in steps[3].select("doc_id", "text").collect()}
    for k, b in rows.items():
        cov = bytearray(len(b))
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                cov[i : i + 200] = b"\1" * 200
        kept = "".join(c for c, at in zip(b.decode(), _starts(b)) if not all(cov[at : at + len(c.encode())]))
        assert left.get(k, "") == kept


def _starts(b):
    return [i for i, x in enumerate(b) if x & 0xC0 != 0x80]


def test_mix_and_pack(steps):
    from tessera.llm.mixing import mix

    want = {r.id: r.copies for r in mix(steps[3]).select("id", "copies").collect()}
    got = Counter(r.doc_id for r in steps[4].collect())
    assert got == {k: v for k, v in want.items() if v}
    packed = steps[5].toPandas()
    whole = packed[packed.start == 0].groupby("doc_id").size().to_dict()
    assert whole == got
    assert (packed.groupby(["doc_id"]).length.sum() == packed[packed.start == 0].groupby("doc_id").doc_tokens.sum()).all()


def test_run_equals_the_stages(spark, small, steps):
    random.seed(0)
    assert corpus_pipeline.run(spark, small).count() == steps[5].count()


def test_odd_rows_go_through_every_stage(spark, small):
    """Nulls in any column, empty and long texts, ties, repeated rows, no rows, extra columns with clashing names."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(200_000))
    rows = [(None, None, None, None, None), (1, "", "en", "web", 0), (2, long, "en", None, len(long)), (3, "a b c d e f g", None, "web", 13), (3, "a b c d e f g", None, "web", 13), (None, "a b c d e f g", "de", "", 13), (4, "tie one", "en", "web", 7), (5, "tie two", "en", "web", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 AS row", "'x' AS part", "2 AS key", "3 AS node", "'b' AS body", "4 AS batch", "5 AS copies", "6 AS size", "7 AS score", "8 AS bundle", "'y' AS thash")
    for df in (docs, extra):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, df, small)
            assert out.columns == df.columns, name
            got = out.collect()
            assert len(got) <= len(rows) * 3
            none = f(spark, df.limit(0), small)
            assert none.count() == 0 and none.columns == df.columns, name
        pieces = corpus_pipeline.pack(spark, df, small).toPandas()
        assert len(pieces[pieces.start == 0]) == len(rows)
    # equal texts are one, and the least id stays; a null id comes last
    left = corpus_pipeline.near_copies(spark, docs, small).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in left if r.text and r.text.startswith("a b")) == [(False, 3)]
    assert len([r for r in left if not r.text]) == 1
    # stages can be chained without writing
    chained = corpus_pipeline.pack(spark, corpus_pipeline.mix(spark, corpus_pipeline.near_copies(spark, docs, small), small), small)
    assert chained.count() > 0
