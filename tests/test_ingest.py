import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, search
from tessera.session import new_folder, table
from tessera.streaming.ingest import Ingest

SCHEMA = "k long, text string, removed boolean, seq long"


def ingest(spark, folder, version="1", words=" "):
    def derive(df):
        return df.select("k", F.explode(F.split("text", words)).alias("w")).where("w <> ''")

    return Ingest(spark, folder, "k", SCHEMA, derive, "k long, w string", version, "seq")


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def state(i):
    return sorted((r.k, r.text) for r in i.base().collect()), sorted((r.k, r.w) for r in i.derived().collect())


def test_a_batch_that_runs_again_leaves_equal_tables(spark):
    i = ingest(spark, new_folder(spark, "i"))
    assert state(i) == ([], [])
    i.sink(rows(spark, (1, "a b", False, 1), (2, "c", None, 1), (None, "x", None, 1), (3, "", None, 1)), 0)
    before = state(i)
    assert before == ([(1, "a b"), (2, "c"), (3, "")], [(1, "a"), (1, "b"), (2, "c")])
    i.sink(rows(spark, (1, "a b", False, 1), (2, "c", None, 1), (None, "x", None, 1), (3, "", None, 1)), 0)
    assert state(i) == before and i.stale().count() == 0
    i.sink(rows(spark, (1, "old", False, 1), (1, "d", False, 2), (2, None, True, 3)), 1)
    assert state(i) == ([(1, "d"), (3, "")], [(1, "d")])
    i.sink(rows(spark, (2, "e f", False, 9)), 2)
    assert state(i) == ([(1, "d"), (2, "e f"), (3, "")], [(1, "d"), (2, "e"), (2, "f")])


def test_new_rules_derive_only_what_lacks_them(spark):
    folder = new_folder(spark, "i")
    i = ingest(spark, folder)
    i.sink(rows(spark, (1, "a-b c", False, 1), (2, "d-e", False, 1)), 0)
    i.sink(rows(spark, (2, "f-g", False, 1), (4, "gone", True, 1)), 1)
    j = ingest(spark, folder, "2", "-")
    assert sorted(tuple(r) for r in j.stale().collect()) == [("1", 0), ("2", 1)] and j.derived().count() == 0
    j.sink(rows(spark, (3, "h-i", False, 1)), 2)
    for _ in range(2):
        j.recompute()
        assert state(j)[1] == [(1, "a"), (1, "b c"), (2, "f"), (2, "g"), (3, "h"), (3, "i")]
        assert j.stale().count() == 0
    assert state(i)[1] == [(1, "a-b"), (1, "c"), (2, "f-g")]  # the older rules' tables are as they were


@pytest.mark.parametrize("query", ["license", "General Public License", "GPL", "the", "beta", "inter national", "é", "x", "nowhere to be found", "日", "of the", "noncommercial"])
def test_postings_find_what_reading_every_text_finds(spark, small, query):
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "ab"), (-3, "日本 non commercial, β GPL"), (-4, "GPLx")], "doc_id long, text string"))
    got = {(r.doc_id, r.n) for r in postings.counted(docs, postings.postings(docs), query).collect()}
    assert got == {(r.doc_id, r.n) for r in search.counted(docs, query).collect()}


def test_only_candidates_are_searched(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    p = postings.stored(postings.postings(docs), new_folder(spark, "p"), 4)
    c = postings.candidates(p, "Apache License")
    held = search.counted(docs, "Apache License").count()
    assert held <= c.count() < docs.count() / 4
    plan = p.where(F.col("gram").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    assert postings.candidates(p, "ab") is None


def test_nothing_derived_is_sorted(spark, tmp_path):
    i = ingest(spark, f"file://{tmp_path}/i")
    i.sink(rows(spark, (1, "a b", False, 1), (2, "c", None, 1)), 0)
    i.sink(rows(spark, (1, "d", False, 2)), 1)
    assert not list(tmp_path.glob("i/*/*/what=*"))  # a write into folders by kind sorts each task's rows
    plan = i.derived()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Sort [" not in plan
    assert state(i)[1] == [(1, "d"), (2, "c")] and i.derived_at_most() == 4


def test_more_postings_lie_in_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FILE_ROWS", 100)
    p = spark.range(1000).select((F.col("id") % 7).alias("gram"), F.col("id").alias("doc_id"))
    assert postings.stored(p, f"file://{tmp_path}/p", 2, most=p.count()).count() == 1000
    assert len(list(tmp_path.glob("p/part-*"))) == 10
