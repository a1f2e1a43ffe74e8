"""Plans over questions: sections, sessions, and questions made by a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import questions as Q, quiz, sections
from tessera.plans.catalog import query
from tessera.session import dealt, table

#: Documents of some ten paragraphs that a task reads.
DOCS = 20_000

_LINES = """SELECT l_suppkey AS doc, concat('S', CAST(l_partkey % 40 AS VARCHAR(9))) AS section, CASE WHEN l_quantity > 10 THEN concat('T', CAST(l_partkey AS VARCHAR(9))) END AS title, l_orderkey % 300 + 1 AS page, CASE WHEN l_returnflag = 'A' THEN 'verified' ELSE 'open' END AS status, l_linenumber AS n, l_orderkey AS o, l_partkey AS p FROM lineitem"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_LINES.replace("FROM lineitem", "FROM {l}"), l=table(s, d, "lineitem"))


@query(f"""WITH x AS ({_LINES}), g AS (SELECT doc, section, min(page) AS start, max(page) AS "end", count(*) FILTER (n <= 4) AS questions, count(*) FILTER (n <= 4 AND status = 'verified') AS verified, count(*) AS w FROM x GROUP BY 1, 2),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc ORDER BY w DESC, section) <= 10)
SELECT doc, section, start, "end", questions, verified, questions >= 5 AND verified >= 0.6 * questions AS worthy, CAST((start - 1) // 32 AS INTEGER) AS "window", greatest(1, start - 1) AS lo, least(300, "end" + 1) AS hi FROM k WHERE questions > 0""")
def section_index(s: SparkSession, d: str) -> DataFrame:
    x = _lines(s, d)
    i = quiz.section_index(x.where("n <= 4"), x.where("n > 4"), 10).drop("title")
    lo, hi = quiz.padded(F.col("start"), F.col("end"), F.lit(300))
    return i.withColumn("worthy", quiz.worthy(F.col("questions"), F.col("verified"))).withColumn("window", quiz.window_of(F.col("start"))).withColumn("lo", lo).withColumn("hi", hi)


@query("""SELECT p_partkey, p_brand || '#' || 'sec-' || p_size || '#' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status, p_name AS stem, 2 AS n FROM part""")
def question_records(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    r = quiz.question_record(F.col("p_brand"), F.concat(F.lit("sec-"), size), F.col("p_partkey").cast("int"), F.col("p_name"), F.array("p_brand", "p_type"), F.lit("A"), F.when(F.col("p_size") % 3 == 0, "verified").otherwise("odd"))
    return table(s, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.id", "r.status", "r.stem", F.size("r.options").alias("n"))


_POOL = "q AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'open' END AS status FROM orders), a AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice > 200000 AS correct FROM orders WHERE o_totalprice > 120000)"


def _pool(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("open").alias("status"), "o_totalprice", F.col("o_orderkey").alias("seq"))
    twice = o.unionByName(o.withColumn("seq", -F.col("seq")))  # every question comes twice
    return twice.select("k", "id", "status", "seq"), o.where("o_totalprice > 120000").select("k", "id", (F.col("o_totalprice") > 200000).alias("correct"))


@query(f"""WITH {_POOL}, p AS (SELECT * FROM q WHERE status = 'verified' OR k NOT IN (SELECT k FROM q WHERE status = 'verified')), s AS (SELECT p.*, a.id IS NOT NULL AS seen FROM p LEFT JOIN a ON a.k = p.k AND a.id = p.id)
SELECT k, id FROM s WHERE NOT seen OR k NOT IN (SELECT k FROM s WHERE NOT seen)""")
def questions_to_ask(s: SparkSession, d: str) -> DataFrame:
    return quiz.ask(*_pool(s, d), "k").select("k", "id")


@query(f"WITH {_POOL} SELECT k, id FROM q WHERE (k, id) IN (SELECT (k, id) FROM a WHERE NOT correct)")
def wrong_to_ask(s: SparkSession, d: str) -> DataFrame:
    return quiz.ask(*_pool(s, d), "k", wrong_only=True).select("k", "id")


_ANSWERS = "x AS (SELECT user_id AS k, event_id % 60 AS id, event_id AS seq, substr('ABC', CAST(event_id % 3 AS INTEGER) + 1, 1) AS chosen, value AS ms FROM events), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY seq) = 1), j AS (SELECT *, CASE WHEN id % 4 <> 0 THEN chosen = substr('ABC', CAST(id % 3 AS INTEGER) + 1, 1) AND seq % 5 <> 0 END AS correct FROM f)"


def _session(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    letter = lambda c: F.substring(F.lit("ABC"), 1, 3).substr((c % 3).cast("int") + 1, F.lit(1))
    chosen = F.when(F.col("event_id") % 5 == 0, "-").otherwise(letter(F.col("event_id")))
    a = table(s, d, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 60).alias("id"), F.col("event_id").alias("seq"), chosen.alias("chosen"), F.col("value").alias("ms"))
    q = s.range(60).select("id", letter(F.col("id")).alias("answer"), F.when(F.col("id") % 4 != 0, "verified").otherwise("open").alias("status"))
    return quiz.session(a, q, ["k"])


@query(f"WITH {_ANSWERS} SELECT k, count(*) FILTER (correct) AS score, count(correct) AS total, round(sum(ms), 4) AS ms FROM j GROUP BY 1")
def attempts(s: SparkSession, d: str) -> DataFrame:
    return _session(s, d)[0].withColumn("ms", F.round("ms", 4))


@query(f"WITH {_ANSWERS} SELECT k, id, CASE WHEN seq % 5 = 0 THEN '-' ELSE chosen END AS chosen FROM j WHERE NOT correct")
def mistakes(s: SparkSession, d: str) -> DataFrame:
    return _session(s, d)[1]


@query("""WITH w AS (SELECT s_suppkey AS k, least(s_suppkey * 7 % 900, 400) + 1 AS lo, greatest(s_suppkey * 7 % 900, 400) + 1 AS hi FROM supplier), i AS (SELECT l_suppkey AS k, l_orderkey AS section, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem),
p AS (SELECT DISTINCT k, unnest(generate_series(a, b)) AS p FROM i)
SELECT w.k, lo, hi, (SELECT count(*) FROM i WHERE i.k = w.k AND b >= lo AND a <= hi) AS sections, (SELECT count(*) FROM p WHERE p.k = w.k AND p BETWEEN lo AND hi) AS n FROM w""")
def range_review(s: SparkSession, d: str) -> DataFrame:
    """Ranges written as text, the sections that lie in them, and how many of their pages were read."""
    x = F.pmod(F.col("s_suppkey") * 7, F.lit(900)) + 1
    w = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), quiz.parse_range(F.concat_ws("-", x.cast("string"), F.lit("401"))).alias("r")).select("k", "r.lo", "r.hi")
    i = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("section"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end"))
    i = dealt(i, 1_000_000, "k")  # a task sorts as many rows at any size
    n = quiz.sections_in(i, w, "k").groupBy("k").agg(F.count("*").alias("sections"))
    read = quiz.read_pages(i.select("k", F.col("start").alias("lo"), F.col("end").alias("hi")), w, "k")
    return read.join(n, "k", "left").select("k", "lo", "hi", F.coalesce("sections", F.lit(0)).alias("sections"), "n")


_PARAS = """SELECT o_custkey AS k, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN concat('SECTION ', CAST(o_orderkey AS VARCHAR(12))) WHEN 1 THEN concat('Head ', CAST(o_orderkey AS VARCHAR(12))) WHEN 3 THEN '1. The answer is A.' ELSE concat('Text ', CAST(o_orderkey AS VARCHAR(12))) END AS text, o_orderkey % 7 AS m FROM orders"""


def _paras(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_PARAS.replace("FROM orders", "FROM {o}"), o=table(s, d, "orders"))


@query(f"""WITH p AS ({_PARAS}) SELECT k, seq, coalesce(last_value(CASE WHEN m = 0 THEN text END IGNORE NULLS) OVER w, last_value(CASE WHEN m = 1 THEN text END IGNORE NULLS) OVER w) AS title FROM p WINDOW w AS (PARTITION BY k ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def titles_near(s: SparkSession, d: str) -> DataFrame:
    return quiz.titles(_paras(s, d), "k", F.col("m") == 1, F.col("text").startswith("SECTION ")).select("k", "seq", "title")


@query(f"""WITH p AS ({_PARAS}), r AS (SELECT *, sum(CASE WHEN m IN (0, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq) AS run FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY seq) AS i, first_value(m) OVER (PARTITION BY k, run ORDER BY seq) AS h, first_value(seq) OVER (PARTITION BY k, run ORDER BY seq) AS hs FROM r)
SELECT k, hs AS seq, count(*) AS n, string_agg(text, chr(10) ORDER BY i) AS text FROM n WHERE h = 3 AND run > 0 AND i <= 3 GROUP BY 1, 2""")
def answer_explanations(s: SparkSession, d: str) -> DataFrame:
    p = _paras(s, d)
    return quiz.explanations(p, "k", Q.answer_list(F.col("text")).isNotNull(), F.col("text").startswith("SECTION "), 2)


@query(f"WITH p AS ({_PARAS}) SELECT k, seq, count(*) FILTER (m = 5) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) > 0 AS found FROM p")
def questions_ahead(s: SparkSession, d: str) -> DataFrame:
    p = _paras(s, d)
    return p.select("k", "seq", quiz.found_ahead(p, "k", F.lit("5"), F.col("m").cast("string"), 5).alias("found"))


#: A page of an answer key whose labels have come off, for each customer; some keys are broken in one way or another.
_KEY = (
    ("12.", "body"), ("13.", "body"), ("ANSWERS", "heading"), ("14.", "body"), ("The answer is B. See above.", "body"), ("More of it.", "body"),
    ("the answers are A, C and D", "body"), ("The answer is E", "body"), ("15. What now?", "body"), ("The answer is A.", "body"),
)


@query("""SELECT c_custkey AS doc, * FROM (VALUES (5, NULL, 12, ['B']), (7, NULL, 13, ['A', 'C', 'D']), (8, NULL, 14, ['E'])) v(seq, section, number, letters), customer WHERE c_nationkey % 4 = 0""".replace("SELECT c_custkey AS doc, *", "SELECT c_custkey AS doc, seq, CAST(section AS VARCHAR) AS section, number, letters"))
def orphan_answers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    rows = F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.lit(t).alias("text"), F.lit(k).alias("kind")) for i, (t, k) in enumerate(_KEY)])
    c = dealt(c.select(F.col("c_custkey").alias("doc"), "c_nationkey"), DOCS, "doc")
    p = c.select("doc", F.lit(1).alias("page"), "c_nationkey", F.inline(rows))
    n = F.col("c_nationkey") % 4  # 1: a label is missing, 2: a gap in the numbers, 3: text between the labels
    p = p.where(~((n == 1) & (F.col("seq") == 2))).withColumn("text", F.when((n == 2) & (F.col("seq") == 4), "16.").when((n == 3) & (F.col("seq") == 3), "Some text").otherwise(F.col("text"))).withColumn("kind", F.when((n == 3) & (F.col("seq") == 3), "body").otherwise(F.col("kind")))
    return Q.orphan_answers(p.drop("c_nationkey"))


@query("""WITH st AS (SELECT o_custkey AS k, sha2 AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS sv, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM (SELECT *, sha256(o_custkey || chr(1) || 'stem ' || o_orderkey) AS sha2 FROM orders WHERE o_orderstatus <> 'P')),
m AS (SELECT o_custkey AS k, sha256(o_custkey || chr(1) || 'stem ' || o_orderkey) AS id, o_orderkey AS seq, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderstatus <> 'F'),
j AS (SELECT coalesce(st.k, m.k) AS k, coalesce(st.id, m.id) AS id, greatest(coalesce(sv, 0), coalesce(v, 0)) AS v, number, seq FROM st FULL JOIN m ON st.k = m.k AND st.id = m.id)
SELECT k, id, CASE v WHEN 1 THEN 'verified' ELSE 'rejected' END AS status, CAST(coalesce(number, coalesce(max(number) OVER (PARTITION BY k), 0) + row_number() OVER (PARTITION BY k, number IS NULL ORDER BY seq)) AS BIGINT) AS number FROM j""")
def made_questions(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice", F.concat(F.lit("stem "), F.col("o_orderkey").cast("string")).alias("stem"))
    stored = o.where("o_orderstatus <> 'P'").select("k", F.sha2(F.concat_ws("\u0001", F.col("k").cast("string"), "stem"), 256).alias("id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected").alias("status"), F.row_number().over(Window.partitionBy("k").orderBy("seq")).alias("number"))
    made = o.where("o_orderstatus <> 'F'").select("k", "seq", "stem", F.when(F.col("o_totalprice") > 150000, "verified").otherwise("rejected").alias("status"))
    return quiz.store_made(stored, made, "k")


_SENT = "h AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS batch FROM orders), sent AS (SELECT k, unnest([k % 9, k % 9 + 1, length(batch)]) AS para FROM h)"


def _sent(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("batch"))
    return quiz.sent_before(o.withColumn("paras", F.array(F.col("k") % 9, F.col("k") % 9 + 1, F.length("batch").cast("long"))), "k")


@query(f"WITH {_SENT} SELECT k, para, count(*) AS n FROM sent GROUP BY 1, 2")
def paragraphs_sent(s: SparkSession, d: str) -> DataFrame:
    return _sent(s, d)


@query(f"""WITH {_SENT}, p AS (SELECT c_custkey AS k, x AS para, x // 4 AS page FROM customer, unnest(generate_series(0, 19)) u(x)), r AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 5 AS page FROM orders), z AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 20 AS para FROM orders WHERE o_orderstatus = 'F')
SELECT p.k, page, p.para, CAST(row_number() OVER (PARTITION BY p.k ORDER BY z.para IS NOT NULL, page, p.para) AS INTEGER) AS place FROM p LEFT JOIN z ON z.k = p.k AND z.para = p.para WHERE (p.k, page) IN (SELECT (k, page) FROM r) AND (p.k, p.para) NOT IN (SELECT (k, para) FROM sent)""")
def next_passages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("para")).withColumn("page", F.floor(F.col("para") / 4))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("page"), (F.col("o_orderkey") % 20).alias("para"), "o_orderstatus")
    return quiz.passages(p, o, _sent(s, d), o.where("o_orderstatus = 'F'"), "k").select("k", "page", "para", "place")


@query("""SELECT c_custkey AS k, seq, reason FROM customer, (VALUES (1, NULL), (2, 'stem'), (3, 'options'), (4, 'alike'), (5, 'answer'), (6, 'dup'), (7, 'digits'), (8, 'evidence'), (9, NULL)) v(seq, reason)""")
def grounded_questions(s: SparkSession, d: str) -> DataFrame:
    """Nine made questions for each customer, each but two with another fault."""
    good, q, src = ["One", "Two", "Three", "4"], "costs 4 of", F.concat(F.lit("All that "), F.col("c_name"), F.lit(" costs 4 of 12 and «more»."))
    rows = [
        (1, "What does it cost?", good, "D", q), (2, " ", good, "A", q), (3, "a?", good[:3], "A", q), (4, "b?", ["One", "one ", "Two", "4"], "A", q), (5, "c?", good, "F", q),
        (6, "what does it cost? ", good, "A", q), (7, "Is it 7777777?", good, "A", q), (8, "d?", good, "A", "costs 5 of"), (9, "Of 12?", good, "A", "of 12, and more"),
    ]
    made = F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(t).alias("stem"), F.array(*map(F.lit, o)).alias("options"), F.lit(a).alias("answer"), F.lit(e).alias("quote")) for n, t, o, a, e in rows])
    m = table(s, d, "customer").select(F.col("c_custkey").alias("k"), src.alias("source"), F.inline(made))
    return quiz.grounded(m, "k").select("k", "seq", "reason")


_ROMAN = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII']"


@query(f"""WITH p AS (SELECT l_suppkey % 10 AS doc, l_orderkey % 400 + 1 AS page, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey % 400, l_orderkey, l_linenumber) AS seq, l_linenumber AS n, l_partkey % 97 AS number, {_ROMAN}[l_partkey % 12 + 1] AS named, {_ROMAN}[(l_orderkey % 400) // 36 + 1] AS head FROM lineitem),
x AS (SELECT *, CASE WHEN n = 1 THEN head END AS h, CASE WHEN n = 3 THEN named END AS own, n > 1 AS item, n >= 4 AS answer FROM p),
a AS (SELECT *, coalesce(own, last_value(h IGNORE NULLS) OVER (PARTITION BY doc, (page - 1) // 32 ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS section FROM x),
s AS (SELECT doc, section, min(page) AS start, max(page) AS "end", count(*) AS w FROM a WHERE item AND section IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, min(page), section) <= 9),
z AS (SELECT doc, max(page) AS last FROM p GROUP BY 1),
j AS (SELECT x.*, s.section AS want FROM x JOIN s USING (doc) JOIN z USING (doc) WHERE page BETWEEN greatest(1, start - 1) AND least(last, "end" + 1)),
b AS (SELECT *, coalesce(own, last_value(h IGNORE NULLS) OVER (PARTITION BY doc, want ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS section FROM j),
n AS (SELECT doc, section, number, bool_or(NOT answer) AS asked, bool_or(answer) AS answered FROM b WHERE item AND section = want GROUP BY 1, 2, 3),
c AS (SELECT doc, section, count(*) FILTER (asked) AS questions, count(*) FILTER (asked AND answered) AS answered FROM n GROUP BY 1, 2)
SELECT doc, section, start, "end", coalesce(questions, 0) AS questions, coalesce(answered, 0) AS answered FROM s LEFT JOIN c USING (doc, section)""")
def sections_in_two_passes(s: SparkSession, d: str) -> DataFrame:
    """Books of 400 pages: headings, questions, questions that name a section, and answers, which may stand far from them."""
    roman = F.split(F.lit("I II III IV V VI VII VIII IX X XI XII"), " ")
    x = table(s, d, "lineitem").select((F.col("l_suppkey") % 10).alias("doc"), (F.col("l_orderkey") % 400 + 1).alias("page"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 97).cast("string").alias("number"), F.get(roman, (F.col("l_partkey") % 12).cast("int")).alias("named"))
    seq = F.struct("l_orderkey", "l_linenumber")  # the order in a page
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Section "), F.get(roman, F.floor((F.col("page") - 1) / 36).cast("int")), F.lit(" of it")))
    text = text.when(F.col("l_linenumber") == 2, F.concat("number", F.lit(". What is it?"))).when(F.col("l_linenumber") == 3, F.concat_ws("-", "named", F.concat("number", F.lit(". And this?"))))
    paras = x.select("doc", "page", seq.alias("seq"), text.otherwise(F.concat("number", F.lit(". The answer is B"))).alias("text"))
    return sections.index(paras, 9)
