"""Plans over built texts and records whose outcome is known from how they were built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates, parse, text as T
from tessera.operators import flow, merge, phrases, questions as Q
from tessera.plans.catalog import query
from tessera.session import dealt, table
from tessera.sources import records


#: Customers whose pages a task reads.
DOCS = 20_000


def _c(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").withColumn("k", F.col("c_custkey"))


@query("""SELECT c_custkey AS k, 'rec' AS kind, 'customer' AS name, 1 AS n FROM customer WHERE c_nationkey % 5 < 3 UNION ALL SELECT c_custkey, 'bad', NULL, 1 FROM customer WHERE c_nationkey % 5 = 3 UNION ALL SELECT c_custkey, 'long', 'customer', 1 FROM customer WHERE c_nationkey % 5 = 4""")
def dump_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of a dump: good ones, ones that are cut off, and ones beyond the longest."""
    n = F.col("c_nationkey") % 5
    rec = F.to_json(F.struct(F.lit("rec").alias("t"), F.lit("customer").alias("s"), F.struct("c_custkey", "c_name").alias("v")))
    raw = F.when(n == 3, F.expr("substring(r, 1, length(r) - 2)")).when(n == 4, F.regexp_replace("r", '"v":', '"pad":"' + "x" * 300 + '","v":')).otherwise(F.col("r"))
    lines = records.classified(_c(s, d).withColumn("r", rec).select(F.concat(raw).alias("value")), 300)
    return lines.select(F.regexp_extract("value", '"c_custkey":([0-9]+)', 1).cast("long").alias("k"), "kind", "name", F.lit(1).alias("n"))


@query("""SELECT 'customer' AS name, count(*) FILTER (c_nationkey <> 3) AS n, count(*) AS said, count(*) FILTER (c_nationkey = 3) AS bad, 0::BIGINT AS long, false AS truncated FROM customer""")
def dump_counts(s: SparkSession, d: str) -> DataFrame:
    """What a dump holds against what its end line says."""
    c = _c(s, d)
    rec = F.to_json(F.struct(F.lit("rec").alias("t"), F.lit("customer").alias("s"), F.struct("c_custkey").alias("v")))
    body = c.select(F.when(F.col("c_nationkey") == 3, "{oops").otherwise(rec).alias("value"))
    end = c.agg(F.count("*").alias("n")).select(F.to_json(F.struct(F.lit("end").alias("t"), F.create_map(F.lit("customer"), "n").alias("counts"))).alias("value"))
    return records.report(records.classified(body.unionByName(end)))


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def dump_records(s: SparkSession, d: str) -> DataFrame:
    c = _c(s, d).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    lines = records.classified(c.select(F.to_json(F.struct(F.lit("rec").alias("t"), F.lit("c").alias("s"), F.struct("*").alias("v"))).alias("value")))
    return records.records(lines, "c", "c_custkey bigint, c_name string, c_acctbal double")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, 1 AS line, c_name AS a, 'x, "y"' || chr(10) || 'z' AS b, NULL AS note FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'only', NULL, 'short' FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 3, '"open', ' then', 'quote' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 3 END, 'p', 'q', 'wide' FROM customer""")
def parsed_csv(s: SparkSession, d: str) -> DataFrame:
    """A file for each customer: quoted cells over lines, a short row, a quote that never closes, a wide row."""
    body = F.concat(F.lit("a,b\n"), "c_name", F.lit(',"x, ""y""\nz"\nonly\n'), F.when(F.col("k") % 2 == 0, '"open, then\n').otherwise(""), F.lit("p,q,r\n"))
    return records.parse_csv(_c(s, d).select(F.col("k").cast("string").alias("path"), body.alias("value")), ["a", "b"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS slug, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2024-01-0' || (c_nationkey % 9 + 1) END AS date, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['a', 'b c'] END AS tags, CASE WHEN c_custkey % 3 = 0 THEN 'no block' ELSE 'body' END AS body,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey % 9 END DESC NULLS LAST, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer""")
def blog_posts(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("k") % 3 == 0, "no block").otherwise(F.concat(F.lit("---\nTitle: "), "c_name", F.lit("\ndate:  2024-01-0"), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit("\ntags: [a, b c, ]\n---\nbody")))
    p = records.front_matter(_c(s, d).select(F.col("k").cast("string").alias("slug"), raw.alias("value")))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last(F.try_to_timestamp("date")), "slug")
    return p.join(_c(s, d).select(F.col("k").cast("string").alias("slug"), "c_nationkey"), "slug").withColumn("place", F.row_number().over(w)).drop("c_nationkey")


@query("""SELECT c_custkey AS name, '{"nbformat":4,"nbformat_minor":5,"metadata":{},"cells":[{"cell_type":"markdown","metadata":{},"source":["# ' || c_name || '"]},{"cell_type":"code","metadata":{},"source":["x = 1"]}]}' AS json FROM customer""")
def notebook_files(s: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.struct(F.lit(2).alias("seq"), F.lit("code").alias("kind"), F.lit("x = 1").alias("source")), F.struct(F.lit(1).alias("seq"), F.lit("markdown").alias("kind"), F.concat(F.lit("# "), "c_name").alias("source")))
    return records.notebooks(_c(s, d).select(F.col("k").alias("name"), F.inline(cells)))


_CLOCKS = "m AS (SELECT o_custkey AS k, max(o_orderkey) AS clock, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_custkey AS k, max(o_orderkey) AS clock, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


@query(f"WITH {_CLOCKS} SELECT k, CASE WHEN t.clock > coalesce(m.clock, 0) THEN t.v ELSE m.v END AS v, CASE WHEN t.clock > coalesce(m.clock, 0) THEN t.clock ELSE m.clock END AS clock FROM m FULL JOIN t USING (k)")
def later_groups(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    side = lambda x, n: o.where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k")).agg(F.struct(F.max("o_orderkey").alias("clock"), F.max("o_totalprice").alias("v")).alias(n))
    j = side("F", "m").join(side("O", "t"), "k", "full")
    return j.select("k", *[c.alias(n) for n, c in merge.later_group("m", "t", "clock", ["v"]).items()])


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN ['a', 'b', 'c'] WHEN c_nationkey % 3 = 1 THEN ['a', 'b', 'd'] ELSE ['d', 'a'] END AS list FROM customer""")
def capped_unions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    lst = lambda *x: F.array(*map(F.lit, x))
    a = F.when(n == 0, lst("a", "b", "a", "c")).when(n == 1, lst("a", "b"))
    b = F.when(n == 0, lst("d")).when(n == 1, lst("b", "d", "e")).otherwise(lst("d", "d", "a"))
    return _c(s, d).select("c_custkey", merge.union_capped(a, b, 3).alias("list"))


@query("""SELECT c_custkey AS k, p[1] AS at, p[2] AS n, concept FROM customer, (VALUES ([1, 3], 'hf'), ([5, 1], 'heart'), ([9, 2], 'valve')) v(p, concept)""")
def phrase_dictionary(s: SparkSession, d: str) -> DataFrame:
    """Phrases of a dictionary in texts: the longest counts, plurals and case do not, ambiguous ones do not."""
    dic = s.createDataFrame([("heart failure class", "hf"), ("heart", "heart"), ("failures", "f1"), ("failure", "f2"), ("aortic valves", "valve"), ("valve", "v")], "term string, concept string")
    t = F.concat(F.lit("The Heart failures class. My hearts, failure: áortic... "), F.lit("x Aortic valve "), F.col("c_name"))
    c = dealt(_c(s, d).select("k", "c_name"), DOCS, "k")  # matches of a text meet where it was dealt to
    return phrases.phrase_matches(c.select("k", F.regexp_replace(t, "áortic", "and").alias("text")), dic, "k")


@query("""SELECT c_custkey, ['One two.', 'Three; ' || repeat('ab ', 80) || repeat('cd,', 17), repeat('cd,', 3) || '.', 'Last!'] AS parts FROM customer""")
def spoken_units(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("One two. Three; "), F.repeat(F.lit("ab "), F.lit(80)), F.repeat(F.lit("cd,"), F.lit(20)), F.lit(". Last!"))
    return _c(s, d).select("c_custkey", phrases.speech_units(t).alias("parts"))


@query("""SELECT c_custkey, ['7' || CAST(c_custkey AS VARCHAR) || '.5'] AS "foreign", ['It has 12', 'No number'] AS points, ['of 3'] AS sub FROM customer""")
def pruned_points(s: SparkSession, d: str) -> DataFrame:
    """Numbers that a source lacks, and points without those that name such."""
    src = F.lit("Of 12 there were 3, at 1,000.50")
    own = F.concat(F.lit("12, 1000.5 and 7"), F.col("c_custkey").cast("string"), F.lit(".50"))
    pt = lambda t, *sub: F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, sub)).cast("array<string>").alias("sub"))
    out = phrases.prune_points(F.array(pt("It has 12 in all", "of 3", "of 4", " "), pt("It has 13"), pt(""), pt("No number"), pt("One more")), src, 2, 2, 9)
    return _c(s, d).select("c_custkey", phrases.foreign_numbers(own, src).alias("foreign"), out["t"].alias("points"), F.get(out, F.lit(0))["sub"].alias("sub"))


@query("""SELECT c_custkey AS k, v.* FROM customer, (VALUES (0, NULL, 'fence'), (1, '{"a": [1, 2]}', 'commas'), (2, '{"a": "b"}', 'quotes'), (3, '{"a": [1, {"b": "x"}, {"c": "un"}]}', 'closed'), (4, NULL, 'failed'), (5, '{"a": 1}', 'comments')) v(i, value, repairs) WHERE i > 0""")
def repaired_answers(s: SparkSession, d: str) -> DataFrame:
    raw = ['{"a": [1, 2,]}', "{“a”: “b”}", '{"a": [1, {"b": "x"}, {"c": "un', "nothing", '{"a": 1 // one\n}']
    x = _c(s, d).select("k", F.posexplode(F.array(*map(F.lit, raw))).alias("i", "raw"))
    return x.select("k", (F.col("i") + 1).alias("i"), parse.repaired_json("raw").alias("x")).select("k", "i", "x.value", F.array_join("x.repairs", ",").alias("repairs"))


@query("""SELECT c_custkey AS k, v.* FROM customer, (VALUES ('exact', 'a "plain" quote - with dash'), ('loose', NULL)) v(how, form)""")
def quote_forms(s: SparkSession, d: str) -> DataFrame:
    src = F.lit("He wrote a “plain” quote – with dash, and ended")
    quotes = F.array(F.lit('a "plain" quote - with dash'), F.lit("plain quote with dash and ended"), F.lit("plain quotes"))
    x = _c(s, d).select("k", F.explode(quotes).alias("q"), src.alias("t")).select("k", "q", parse.evidence("t", "q").alias("how")).where("how IS NOT NULL")
    return x.select("k", "how", F.when(F.col("how") == "exact", F.col("q")).alias("form"))


#: A page of questions and answers for each customer.
_QUIZ = (
    "SECTION I", "1. Which river is long?", "Read the map first.", "A. Short", "B. Long, and this goes", "over to the next page", "C. None", "2. A question without options?", "I-4. Which one?", "A. One", "B. Two",
    "1. The answer is B. Because it is.", "I-4. The answers are A and F.", "5. Pick one", "A. x", "B. y", "6. Pick two", "A. x", "B. y", "5 and 6. The answers are A, and B",
)


@query("""SELECT c_custkey AS doc, v.* FROM customer, (VALUES (NULL, 1, 3, ['B'], 'verified'), ('I', 4, 2, ['A', 'F'], 'unverified'), (NULL, 5, 2, ['A'], 'verified'), (NULL, 6, 2, ['B'], 'verified')) v(section, number, options, answer, status)""")
def parsed_questions(s: SparkSession, d: str) -> DataFrame:
    c = dealt(_c(s, d).select(F.col("k").alias("doc")), DOCS, "doc")
    p = c.select("doc", F.posexplode(F.array(*map(F.lit, _QUIZ))).alias("seq", "text"))
    return Q.verified(p).select("doc", "section", "number", F.size("options").alias("options"), "answer", "status")


@query("""SELECT c_custkey AS k, CASE WHEN c_nationkey % 3 = 0 THEN repeat('*', c_nationkey % 9) ELSE 'sk-0…' || right('000' || c_custkey, 4) END AS masked, CASE c_nationkey % 3 WHEN 0 THEN c_custkey * 1000 WHEN 1 THEN 1704067200000 + c_nationkey * 1000 END AS ms,
CASE c_nationkey % 3 WHEN 0 THEN 'min' WHEN 1 THEN 'day' ELSE 'year' END AS unit FROM customer""")
def small_values(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    key = F.when(n % 3 == 0, F.repeat(F.lit("x"), (n % 9).cast("int"))).otherwise(F.concat(F.lit("sk-0123456789000"), F.col("k").cast("string")))
    ms = F.when(n % 3 == 0, (F.col("k") * 1000).cast("string")).when(n % 3 == 1, F.concat(F.lit("2024-01-01T00:00:"), F.lpad(n.cast("string"), 2, "0"), F.lit("Z"))).otherwise("no time")
    _, unit = dates.span(F.when(n % 3 == 0, n * 1000).when(n % 3 == 1, n * 86400000).otherwise(F.lit(400 * 86400000)))
    return _c(s, d).select("k", T.mask(key).alias("masked"), dates.time_ms(ms).alias("ms"), unit.alias("unit"))


@query("""WITH l AS (SELECT o_custkey AS k, o_orderkey AS line, o_orderkey % 97 * 8 AS y, CASE WHEN o_orderkey % 5 = 0 THEN 30 ELSE 20 END AS x FROM orders), n AS (SELECT *, CASE WHEN y - lag(y) OVER w > 60 OR x > 25 OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY k ORDER BY y, line)),
p AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY y, line ROWS UNBOUNDED PRECEDING) AS para FROM n) SELECT k, CAST(para AS BIGINT) AS para, count(*) AS lines, min(line) AS first FROM p GROUP BY 1, 2""")
def paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Lines to paragraphs: an indent or a wide gap begins one."""
    l = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 97 * 8).alias("y"), F.when(F.col("o_orderkey") % 5 == 0, 30).otherwise(20).alias("x"))  # noqa: E741
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("k").orderBy("y", "line"))
    p = flow.islands(l.withColumn("gap", gap), "k", ["y", "line"], (F.col("gap") > 60) | (F.col("x") > 25), "para")
    return p.groupBy("k", "para").agg(F.count("*").alias("lines"), F.min("line").alias("first"))
