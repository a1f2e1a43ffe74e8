import pytest
from pyspark.sql import functions as F

from tessera.operators import questions as Q
from tessera.operators import quiz, study
from tessera.plans import catalog
from tessera.session import dealt

TEXT = """SECTION I
1. Which river is long?
Read the map first.
A. Short
B. Long, and this goes
over to the next page
C. None
Some prose.
2. A question without options?
3. Which is blue?
A. Sky
C. Grass
I-4. Which one?
A. One
B. Two
1. The answer is B. Because it is.
3. The answer is A.
I-4. The answers are A and F.
5. Pick one
A. x
B. y
6. Pick two
A. x
B. y
5 and 6. The answers are A, and B
7, 8. The answers are A"""


def test_questions(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXT.split("\n"))], "doc int, seq int, text string")
    got = {r.number: r for r in Q.verified(df).collect()}
    assert sorted(got) == [1, 4, 5, 6]
    assert got[1].stem == "Which river is long? Read the map first." and [tuple(o) for o in got[1].options] == [("A", "Short"), ("B", "Long, and this goes over to the next page"), ("C", "None")]
    assert (got[1].answer, got[1].status) == (["B"], "verified") and (got[4].section, got[4].answer, got[4].status) == ("I", ["A", "F"], "unverified")
    assert got[5].answer == ["A"] and got[6].answer == ["B"] and got[6].status == "verified"
    assert Q.verified(df.limit(0)).count() == 0


def mulberry(seed):
    m = 0xFFFFFFFF
    a = (seed + 0x6D2B79F5) & m
    t = ((a ^ (a >> 15)) * (a | 1)) & m
    t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
    return (t ^ (t >> 14)) / 4294967296


def test_study(spark):
    s = [0, 1, 42, 2**31, 2**32 - 1]
    got = [r.x for r in spark.createDataFrame([(x,) for x in s], "s long").select(study.mulberry32("s").alias("x")).collect()]
    assert got == [mulberry(x) for x in s]
    p = spark.createDataFrame([(n,) for n in (0, 3, 12, 100)], "n int").select(study.probes(F.col("n")).alias("p")).collect()
    assert p[0].p == [] and p[1].p == [1, 2, 3] and len(p[2].p) == 12 and p[3].p[0] == 13 and p[3].p[-1] == 87 and len(p[3].p) == 12
    d = spark.createDataFrame([(None, None), (False, 5), (False, 50), (True, 1)], "s boolean, d int").select(study.due(F.col("s"), F.col("d"), F.lit(10)).alias("x")).collect()
    assert [r.x for r in d] == [True, True, False, False]
    q = spark.createDataFrame([("a", i, [None, True, False][i % 3]) for i in range(30)], "k string, id int, last boolean")
    o = [r.last for r in study.session_order(q, "k", 1).orderBy("place").collect()]
    assert o == [None] * 10 + [False] * 10 + [True] * 10
    n = spark.createDataFrame([("g", i) for i in range(20)], "graph string, id int")
    e = spark.createDataFrame([("g", 0, i) for i in range(25)] + [("g", 3, 0), ("g", 5, 6), ("h", 1, 2)], "graph string, a int, b int")
    assert sorted((r.a, r.b) for r in study.valid_edges(n, e, 4).collect()) == [(0, 1), (0, 5), (0, 6), (5, 6)]


@pytest.mark.parametrize("name", ["parsed_questions", "orphan_answers"])
def test_documents_are_dealt_before_they_become_paragraphs(spark, small, name):
    lines = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [i for i, x in enumerate(lines) if "Generate explode" in x or "Generate posexplode" in x or "Generate inline([" in x]
    assert made
    for i in made:  # what follows a line is below it
        assert "REPARTITION_BY_NUM" in next((x for x in lines[i:] if "Exchange" in x or "Scan parquet" in x))


def test_dealt_by_rows(spark):
    x = dealt(spark.range(1000), 50, "id")
    assert x.rdd.getNumPartitions() == 20 and x.count() == 1000
    assert dealt(spark.range(3), 50, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_read_pages_are_those_inside_wanted_ranges(spark):
    """all read ranges were sorted and merged; and where none was read, all wanted pages counted as read."""
    read = spark.createDataFrame([(1, 3, 6), (1, 9, 5), (1, 20, 30), (1, 40, 41), (2, 1, 4), (4, None, None)], "k int, lo int, hi int")
    wanted = spark.createDataFrame([(1, 1, 25), (1, 8, 8), (1, 12, 15), (2, 4, 9), (3, 1, 5), (4, 1, 5), (5, None, None)], "k int, lo int, hi int")
    got = {(r.k, r.lo, r.hi): r.n for r in quiz.read_pages(read, wanted, "k").collect()}
    assert got == {(1, 1, 25): 13, (1, 8, 8): 1, (1, 12, 15): 0, (2, 4, 9): 1, (3, 1, 5): 0, (4, 1, 5): 0, (5, None, None): 0}


def test_tasks_of_range_review_keep_their_rows(spark, small):
    """the index is dealt by a number that follows its rows, not by the session's number of partitions."""
    plan = catalog.QUERIES["range_review"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
