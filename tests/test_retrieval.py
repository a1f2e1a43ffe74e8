import pytest

from tessera.operators import search
from tessera.plans.retrieval import evidence_containment


def test_evidence_in_quotes_and_short_passages(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (2, "short one"), (3, "a b c d e f g h"), (4, " ".join(passage.split()[:9])), (5, " ".join(passage.split()[:10]))]
    docs = [(1, f'He said "{passage}".'), (2, "a short one."), (3, "x a b c d e f g h. y"), (4, passage), (5, "none of it"), (6, None), (7, passage.replace(" ten", "  ten")), (8, "(" + passage + ")\n" + passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: (min(h), len(h)) for d, t in docs if (h := [i for i, p in items if t and p in t])}
    assert {r.doc_id: (r.item_id, r.n) for r in evidence_containment(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("few", [10_000, 7])
def test_passages_of_every_length(spark, monkeypatch, few):
    import random

    from tessera.operators import search

    monkeypatch.setattr(search, "FEW", few)
    r = random.Random(3)
    words = "alpha beta gamma delta eps".split()
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(r.randint(0, 30))) for _ in range(120)]
    items = ["beta", "ta gam", "alpha beta gam", "“no", "x" * 5] + [" ".join(r.choice(words) for _ in range(n)) for n in range(1, 13) for _ in range(4)]
    items += [t[3 : 3 + r.randint(5, 90)].strip() or "z" for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(items)), "item_id long, passage string")
    got = {(x.doc_id, x.item_id) for x in search.containing(docs, p, "doc_id", "item_id").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x in t}
    assert search.containing(docs, p.limit(0), "doc_id", "item_id").count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    import random

    from tessera.operators import stats

    monkeypatch.setattr(stats, "BLOCK", 16)
    r = random.Random(4)
    rows = [(i, [r.randint(0, 9) * 1.0, r.randint(0, 9) * 1.0], r.choice("abc")) for i in range(100)]
    train = spark.createDataFrame(rows, "id long, x array<double>, label string")
    got = {x.id: x.label for x in stats.nearest(train, train.where("id % 3 = 0"), 4).collect()}
    want = {}
    for i, x, _ in rows:
        if i % 3 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, j, l) for j, y, l in rows if j != i)[:4]
            labels = [l for _, _, l in near]
            want[i] = min(labels, key=lambda l: (-labels.count(l), labels.index(l)))
    assert got == want
    assert stats.nearest(train, train.limit(0), 4).count() == 0


def test_hits_leave_python_as_whole_numbers(spark):
    docs = spark.createDataFrame([(1, "De la, de"), (2, None), (3, ""), (4, "made of"), (5, "de")], "doc_id long, text string")
    c = search.counted(docs, "de")
    assert sorted((r.doc_id, r.n, [tuple(x) for x in r.h]) for r in c.collect()) == [(1, 2, [(0, 2), (7, 2)]), (5, 1, [(0, 2)])]
    assert "AS _f#" in c._jdf.queryExecution().analyzed().toString()  # not as a list of objects
    assert dict(c.dtypes) == {"doc_id": "bigint", "n": "int", "h": "array<struct<at:int,len:int>>"}
