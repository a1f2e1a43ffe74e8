from pyspark.sql import functions as F

from tessera.functions import cite
from tessera.functions.text import fold
from tessera.operators import anchors


def test_citations(spark):
    rows = [
        ("Dhanasekaran M, et al. J Endocr Soc. 2024.", "etal"), ("[PMID: 12345678]", "id"), ("PMID 12345678.", "id"), ("Smith AB, et al; PMID 1234567", "etal+id"),
        ("Smith AB. Lancet. 2020. doi:10.1000/xyz", "id"), ("Smith AB et al showed that it works", None), ("Plain prose here.", None), ("", None), (None, None),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", cite.citation_kind(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in rows]


def test_reference_runs(spark):
    text = ["It is so.", "Jones CD. A title of the work.", "More of the title.", "2022;40:381.", "After.", "Roe EF et al. Open head goes on.", "and on", "and on", "and on", "and on", "2021;3:4.", "PMID 1234567"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, seq int, text string")
    got = [r.reference for r in cite.mark_references(df).orderBy("seq").collect()]
    assert got == [False, True, True, True, False, False, False, False, False, False, True, True]


def test_anchors(spark):
    t = "One fish, two fish. Red fish, blue fish. This one has a little star."
    a = spark.createDataFrame([(1, t)], "doc_id int, text string").select("doc_id", anchors.anchor(F.col("text"), F.lit(19), F.lit(28)).alias("a")).select("doc_id", "a.*")
    r = a.first()
    assert (r.exact, r.at) == ("Red fish", 20) and t[:20].endswith(r.prefix) and t[28:].startswith(r.suffix)
    moved = spark.createDataFrame([(1, "New start. Red fish elsewhere. " + t)], "doc_id int, text string")
    f = anchors.resolve(a, moved).first().found
    assert (f.at, f.len, f.how, f.tie) == (51, 8, "page", False)
    f = anchors.resolve(a, spark.createDataFrame([(1, "x two fish. RÉD-\nfish, blue")], "doc_id int, text string")).first().found
    assert f.how == "across" and (f.at, f.len) == (12, 9)
    assert anchors.resolve(a, spark.createDataFrame([(2, t)], "doc_id int, text string")).first().found is None
    assert anchors.spots("ab ab", "ab", "", "", True) == [(0, 2, 0), (3, 2, 0)]


def test_anchors_by_paragraph_and_written_back(spark):
    old = "Alpha one.\nBeta two and three.\nBeta two and three.\nGamma  four five.\nDelta six."
    new = "Intro.\nBeta two and three.\nAlpha one, changed.\nGamma four\nfive.\nDELTA six!\nsame same"
    docs = lambda t: spark.createDataFrame([(1, t), (2, None)], "doc_id int, text string")
    where = {"two": (old.index("two"), 7), "one": (old.index("one"), 3), "four": (old.index("four"), 9), "delta": (old.index("Delta"), 9)}
    a = None
    for name, (at, n) in where.items():
        own = docs(old).select("doc_id", F.lit(name).alias("name"), anchors.anchor(F.col("text"), F.lit(at), F.lit(at + n)).alias("a")).select("doc_id", "name", "a.*")
        a = own if a is None else a.unionByName(own)
    p = anchors.paragraphs(docs(old)).withColumn("end", F.col("base") + F.length("text"))
    a = a.where("exact IS NOT NULL").join(p.select("doc_id", "base", "end", "hash"), "doc_id").where("at BETWEEN base AND end").drop("base", "end")
    extra = spark.createDataFrame([(1, "tie", "same", "", "", 0, None), (1, "gone", "never", "", "", 0, None), (1, "none", None, None, None, None, None), (2, "null", "x", "", "", 0, None)], "doc_id int, name string, exact string, prefix string, suffix string, at int, hash string")
    r = anchors.resolve(a.unionByName(extra), docs(new))
    got = {x.name: (new[x.found.at : x.found.at + x.found.len], x.found.how, x.found.tie) if x.found else None for x in r.collect()}
    assert got == {"two": ("two and", "para", False), "one": ("one", "page", False), "four": ("four\nfive", "across", False), "delta": ("DELTA six", "fuzzy", False), "tie": ("same", "page", True), "gone": None, "none": None, "null": None}
    back = {x.name: x for x in anchors.write_back(r, docs(new)).collect()}
    assert {k for k, x in back.items() if x.changed} == {"two", "one", "four", "delta"} and len(back) == 8
    assert all(new[x.at : x.at + len(x.exact)] == x.exact and x.hash for x in back.values() if x.changed)
    again = {x.name: x.found for x in anchors.resolve(anchors.write_back(r, docs(new)).drop("changed"), docs(new)).collect()}
    assert {k: (again[k].how, again[k].at) for k in ("two", "one", "delta")} == {k: ("para", back[k].at) for k in ("two", "one", "delta")}
    assert again["four"].how == "across" and again["tie"].tie


def test_anchors_are_found_once(spark):
    """each step made the anchors and all steps before it anew."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    a = spark.createDataFrame([(1, "one fish", "", "", 0), (1, "TWO-fishes", "", "", 9), (1, "fishtwof", "", "", 4), (1, "no", "", "", 0)], "doc_id int, exact string, prefix string, suffix string, at int")
    r = anchors.resolve(a.withColumn("exact", counted("exact")), spark.createDataFrame([(1, "one fish\ntwo fishes")], "doc_id int, text string"))
    assert {x.exact: x.found and (x.found.how, x.found.at) for x in r.collect()} == {"one fish": ("page", 0), "TWO-fishes": ("fuzzy", 9), "fishtwof": ("across", 4), "no": None}
    assert made.value == 4


def test_squeezed_is_the_same_with_and_without_the_table(spark):
    rows = [(f"{chr(i)}A {chr(i)} b-C",) for i in range(1, 256)] + [("É  a  b",), ("",), (None,)]
    d = spark.createDataFrame(rows, "t string")
    table = F.regexp_replace(fold(F.col("t")), anchors._GAPS, "")
    blanks = F.md5(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")))
    assert d.where(~anchors.squeezed(F.col("t")).eqNullSafe(table) | ~anchors.paragraph_hash(F.col("t")).eqNullSafe(blanks)).count() == 0
    assert [x[0] for x in anchors.spots("aaaa", "aa", "", "", True)] == [0, 1, 2]
