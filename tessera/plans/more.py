"""Plans over diagrams, spans, summaries, previews and counts that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates
from tessera.functions.text import fill_query, head_key, safe_link
from tessera.operators import backup, graphs, learning, merge, notes, ranges, recurrence, search, shuffles
from tessera.plans.catalog import query
from tessera.session import table


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'someday' ELSE strftime(o_orderdate, '%Y') || '년 ' || CAST(month(o_orderdate) AS VARCHAR) || '월 ' || CAST(day(o_orderdate) AS VARCHAR) || '일' END AS label FROM orders""")
def date_labels(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("o_orderstatus") == "P", "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(s, d, "orders").select("o_orderkey", dates.label(t).alias("label"))


@query("""WITH g AS (SELECT * FROM (VALUES ('again', 0), ('hard', 1), ('good', 2), ('easy', 3)) v(grade, k)), c AS (SELECT c_custkey, 1.3 + c_nationkey % 10 * 0.15 AS ease, CAST(c_custkey % 40 AS BIGINT) AS days, CAST(c_nationkey % 4 AS BIGINT) AS reps FROM customer),
e AS (SELECT *, greatest(1.3, floor((ease + CASE grade WHEN 'again' THEN -0.2 WHEN 'hard' THEN -0.15 WHEN 'good' THEN 0.0 ELSE 0.15 END) * 100 + 0.5) / 100) AS ne FROM c, g),
x AS (SELECT *, CASE WHEN grade = 'again' THEN 0 ELSE least(365, CASE WHEN reps = 0 THEN CASE grade WHEN 'easy' THEN 4 ELSE 1 END WHEN grade = 'good' AND reps = 1 THEN 6 ELSE greatest(CASE WHEN grade = 'easy' AND reps = 1 THEN 7 ELSE 0 END, days + 1, CAST(floor(days * CASE grade WHEN 'hard' THEN 1.2 WHEN 'good' THEN ne ELSE ne * 1.3 END + 0.5) AS BIGINT)) END) END AS nd FROM e)
SELECT c_custkey, grade, nd AS days FROM x""".replace("1.3 +", "1.3::DOUBLE +").replace("* 0.15 AS", "* 0.15::DOUBLE AS").replace("-0.2 ", "-0.2::DOUBLE ").replace("-0.15 ", "-0.15::DOUBLE ").replace("0.0 ELSE 0.15 ", "0.0::DOUBLE ELSE 0.15::DOUBLE ").replace("THEN 1.2 ", "THEN 1.2::DOUBLE ").replace("ne * 1.3 ", "ne * 1.3::DOUBLE ").replace("+ 0.5)", "+ 0.5::DOUBLE)"))
def grade_previews(s: SparkSession, d: str) -> DataFrame:
    """What each of four grades would make of a card: all four at once, as one expression."""
    c = table(s, d, "customer").select("c_custkey", (F.lit(1.3) + F.col("c_nationkey") % 10 * F.lit(0.15)).alias("ease"), (F.col("c_custkey") % 40).alias("days"), (F.col("c_nationkey") % 4).cast("long").alias("reps"))
    return c.select("c_custkey", F.inline(learning.previews(F.col("ease"), F.col("days"), F.col("reps")))).select("c_custkey", "grade", "days")


@query("""WITH a AS (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1), b AS (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size = 7 OR p_size = 8 GROUP BY 1), c AS (SELECT p_brand AS k, -count(*) AS n FROM part WHERE p_size < 8 AND p_size <> 7 GROUP BY 1)
SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY 1 HAVING sum(n) > 0""")
def kept_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of keys, kept up to date by what comes and what goes."""
    p = table(s, d, "part").select(F.col("p_brand").alias("k"), "p_size")
    now = merge.counts(p.where("p_size <> 7"), ["k"])
    return merge.recount(now, p.where("p_size IN (7, 8)"), p.where("p_size < 8 AND p_size <> 7"), ["k"])


@query("""WITH d AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0), r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem), p AS (SELECT DISTINCT k, unnest(generate_series(lo, hi)) AS p FROM r),
m AS (SELECT k, p FROM p WHERE k NOT IN (SELECT k FROM d) OR (k % 2 = 0) OR NOT p BETWEEN 100 AND 900 UNION SELECT k, x FROM d, generate_series(100, 900) u(x) WHERE k % 2 = 0), n AS (SELECT *, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM m)
SELECT k, min(p) AS lo, max(p) AS hi FROM n GROUP BY k, g""")
def marked_read(s: SparkSession, d: str) -> DataFrame:
    """Pages 100 to 900 marked as read (even keys) or as unread, for documents that are there; others stay as they are."""
    read = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_linenumber")).alias("hi"))
    live = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    marks = s.range(1, 0).select(F.col("id").alias("k")).unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))).select("k", F.lit(100).cast("long").alias("lo"), F.lit(900).cast("long").alias("hi"), (F.col("k") % 2 == 0).alias("on"))
    return ranges.marked(read, marks, live, "k")


@query("""WITH e AS (SELECT user_id AS k, event_type || '|' || CASE WHEN event_id % 3 = 0 THEN 'i' || event_id % 10 ELSE 'L' || event_id % 5 || '|' || event_type END AS u, ts, event_id FROM events), l AS (SELECT *, lag(u) OVER (PARTITION BY k ORDER BY ts, event_id) AS p FROM e) SELECT k, count(*) AS n FROM l WHERE p IS DISTINCT FROM u GROUP BY 1""")
def units_read(s: SparkSession, d: str) -> DataFrame:
    """Units of text that were read, where the parts of one unit that follow each other count once."""
    line = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 5).cast("string"))
    e = table(s, d, "events").select(F.col("user_id").alias("k"), learning.unit_key(F.col("event_type"), line, F.col("event_type"), F.col("event_id") % 10).alias("u"), "ts", "event_id")
    before = F.lag("u").over(Window.partitionBy("k").orderBy("ts", "event_id"))
    return e.where("true").withColumn("p", before).where(~F.col("u").eqNullSafe(F.col("p"))).groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS para, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey // 8 END AS seg FROM orders),
t AS (SELECT *, last_value(para IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM u), p AS (SELECT a.k, a.i, max(b.i) AS j FROM u a JOIN u b ON a.k = b.k AND b.i < a.i AND b.seg IS NOT NULL AND b.seg IS DISTINCT FROM a.seg WHERE a.seg IS NOT NULL GROUP BY 1, 2),
n AS (SELECT a.k, a.i, max(b.i) AS j FROM u a JOIN u b ON a.k = b.k AND b.i < a.i AND b.seg IS NOT NULL WHERE a.seg IS NULL GROUP BY 1, 2)
SELECT u.k, CAST(u.i AS INTEGER) AS i, CASE WHEN u.seg IS NULL THEN (SELECT para FROM u b WHERE b.k = n.k AND b.i = n.j) ELSE coalesce((SELECT para FROM u b WHERE b.k = p.k AND b.i = p.j), u.para) END AS target FROM u LEFT JOIN p ON p.k = u.k AND p.i = u.i LEFT JOIN n ON n.k = u.k AND n.i = u.i""")
def summary_targets(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("at"), F.col("o_orderpriority").alias("para"), F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_orderkey") / 8)).alias("seg"))
    return notes.summary_target(o, "k").select("k", F.col("at").alias("i"), "target")


@query("""WITH p AS (SELECT conv_id AS k, turn AS seq, min(text) AS text FROM conversations GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM p)
SELECT k, seq, greatest(50, a) - a AS lo, least(400, a + length(text)) - a AS hi FROM o WHERE a < 400 AND a + length(text) > 50""")
def hit_ranges(s: SparkSession, d: str) -> DataFrame:
    """A hit at 50 to 400 of each conversation's text, as the stretches of its lines that it covers."""
    p = table(s, d, "conversations").groupBy(F.col("conv_id").alias("k"), F.col("turn").alias("seq")).agg(F.min("text").alias("text"))
    hits = p.select("k").distinct().select("k", F.lit(50).alias("at"), F.lit(350).alias("len"))
    return search.line_ranges(hits, notes.placed(p, "k"), "k").select("k", "seq", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query("""SELECT c_custkey, '1 ' || c_name || chr(10) || '1.1 sub' || chr(10) || '1.1.1 ' || c_mktsegment || chr(10) || '3 last' AS text, 4 AS lines FROM customer""")
def outline_texts(s: SparkSession, d: str) -> DataFrame:
    leaf = lambda t: F.struct(t.alias("t"))
    mid = lambda t, sub: F.struct(t.alias("t"), sub.alias("sub"))
    none = F.array().cast("array<struct<t:string>>")
    nothing = F.array().cast("array<struct<t:string,sub:array<struct<t:string>>>>")
    points = F.array(mid(F.col("c_name"), F.array(mid(F.lit(" sub "), F.array(leaf(F.col("c_mktsegment")))))), mid(F.lit(" "), nothing), mid(F.lit("last"), F.array(mid(F.lit(""), none))))
    lines = graphs.outline_lines(points)
    return table(s, d, "customer").select("c_custkey", F.array_join(lines, "\n").alias("text"), F.size(lines).alias("lines"))


_EDGES = "SELECT DISTINCT l_returnflag AS g, l_suppkey % 12 AS a, 100 + l_partkey % 15 AS b FROM lineitem WHERE l_quantity = 50"


@query(f"""WITH e AS ({_EDGES}) SELECT x.g, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.a < y.a AND x.b > y.b GROUP BY 1""")
def crossings(s: SparkSession, d: str) -> DataFrame:
    """Straight lines between two layers: how many pairs cross."""
    e = s.sql(_EDGES.replace("FROM lineitem", "FROM {l}"), l=table(s, d, "lineitem"))
    pts = e.select("g", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("a").cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("b") - 100).cast("double").alias("x2"), F.lit(1.0).alias("y2"))
    return graphs.crossings(pts, "g")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, p_size + 1 + p_partkey % 3 AS b FROM part WHERE p_size < 20), n AS (SELECT a AS n FROM e UNION SELECT b FROM e), w AS (SELECT n, 0 AS l FROM n WHERE n NOT IN (SELECT b FROM e) UNION SELECT b, l + 1 FROM w JOIN e ON a = n) SELECT n AS node, CAST(max(l) AS INTEGER) AS level FROM w GROUP BY 1""")
def layers(s: SparkSession, d: str) -> DataFrame:
    """Nodes of an acyclic graph by the longest way to them."""
    e = table(s, d, "part").where("p_size < 20").select(F.col("p_size").cast("long").alias("a"), (F.col("p_size") + 1 + F.col("p_partkey") % 3).alias("b")).distinct()
    return graphs.layers(e.withColumn("graph", F.lit("g")), "graph").drop("graph")


@query("""SELECT c_custkey, ['one', 'three'] AS names, 'https://x.org/?q=heart%20' || c_custkey AS first FROM customer""")
def lookups(s: SparkSession, d: str) -> DataFrame:
    """Where a selected text can be looked up: links with a place for it, filled and found safe."""
    links = [("one", "https://x.org/?q={q}"), ("two", "http://x.org/{q}"), ("three", "https://y.org/{q}/x"), ("four", "https://z.org/")]
    q = F.trim(F.regexp_replace(F.concat(F.lit(" heart \n"), F.col("c_custkey").cast("string")), r"\s+", " "))
    ok = F.array_compact(F.array(*[F.when((safe_link(fill_query(F.lit(u), q)) == "ok") & F.lit("{q}" in u), F.struct(F.lit(n).alias("name"), fill_query(F.lit(u), q).alias("href"))) for n, u in links]))
    return table(s, d, "customer").select("c_custkey", ok["name"].alias("names"), F.get(ok, F.lit(0))["href"].alias("first"))


@query("""WITH x AS (SELECT source, doc_id, length(text) - length(replace(lower(text), 'the ', 'the')) AS n FROM documents) SELECT source, count(*) FILTER (n > 0) AS docs, sum(n) AS hits, count(*) AS searched, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM x JOIN documents USING (source, doc_id) GROUP BY 1""")
def library_search(s: SparkSession, d: str) -> DataFrame:
    """One search over a library, book by book (source): how many texts hold it, how often, and how much was searched."""
    t = F.lower("text")
    n = F.length("text") - F.length(F.replace(t, F.lit("the "), F.lit("the")))
    return table(s, d, "documents").select("source", n.alias("n"), F.octet_length("text").alias("b")).groupBy("source").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("hits"), F.count("*").alias("searched"), F.sum("b").cast("long").alias("bytes"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 1 OR (c_acctbal <= 0 AND c_nationkey = 7 AND o_orderstatus = 'F')""")
def cards_of_document(s: SparkSession, d: str) -> DataFrame:
    """The cards of document 1, and those whose document is gone but whose id says that they come from its file (a nation's)."""
    c = table(s, d, "customer")
    name = lambda file, front: F.sha2(F.concat_ws("\u0001", file, front), 256)
    front = F.col("o_orderkey").cast("string")
    cards = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderkey").alias("id"), front.alias("front"), F.when(F.col("o_orderstatus") == "F", name(F.col("c_nationkey").cast("string"), front)).otherwise("other").alias("name"))
    live = c.where("c_acctbal > 0 OR c_custkey = 1").select(F.col("c_custkey").cast("string").alias("doc"))
    return notes.cards_of(cards, live, "1", "7", name)


@query("""SELECT p_partkey, p_size % 3 = 0 AS same FROM part""")
def same_values(s: SparkSession, d: str) -> DataFrame:
    """Are two nested values the same? Absent fields are as null, and the order of a map does not count."""
    v = lambda k, x: F.struct(F.array(F.col("p_size"), F.lit(None)).alias("a"), F.map_from_arrays(k, F.array(F.lit(1), x)).alias("m"))
    a = v(F.array(F.lit("x"), F.lit("y")), F.lit(2))
    b = v(F.array(F.lit("x"), F.lit("y")), F.when(F.col("p_size") % 3 == 0, 2).otherwise(3))
    return table(s, d, "part").select("p_partkey", merge.same(a, b).alias("same"))


@query("""SELECT l_suppkey AS k, count(DISTINCT lower(l_returnflag || l_linestatus)) AS heads, count(*) AS n FROM lineitem GROUP BY 1""")
def heading_keys(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit(" "), "l_returnflag", F.lit("—"), "l_linestatus", F.lit(". "))
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), head_key(t).alias("h")).groupBy("k").agg(F.countDistinct("h").alias("heads"), F.count("*").alias("n"))


@query("""SELECT o_custkey AS k, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3:' || o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders""")
def shuffled(s: SparkSession, d: str) -> DataFrame:
    """An order by chance that a seed repeats."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    return learning.shuffled(o, "k", "id", 3)


@query("""SELECT c_custkey, 'use [KEY] or Bearer' AS scrubbed, c_nationkey % 2 = 0 AS secret FROM customer""")
def scrubbed_texts(s: SparkSession, d: str) -> DataFrame:
    t = F.lit("use sk-0123456789abcdefghij or Bearer")
    u = F.when(F.col("c_nationkey") % 2 == 0, t).otherwise("none at all")
    return table(s, d, "customer").select("c_custkey", backup.scrub(t).alias("scrubbed"), backup.has_secret(u).alias("secret"))


_RANDOM = """SELECT *, CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296 AS r FROM (SELECT *, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296) AS u FROM
(SELECT *, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM (SELECT *, CAST((seed + nth * 1831565813) % 4294967296 AS HUGEINT) AS a FROM {0})))"""
_SWAPS = "list_reduce(list_prepend({0}, list_filter({1}, lambda x: x[1] > 0)), lambda a, x: list_transform(generate_series(1, len(a)), lambda k: CASE WHEN k = x[1] + 1 THEN a[x[2] + 1] WHEN k = x[2] + 1 THEN a[x[1] + 1] ELSE a[k] END))"


@query(f"""WITH e AS (SELECT r_regionkey AS exam, 1000 * r_regionkey + 7 AS seed, 40 + r_regionkey AS n FROM region), q AS (SELECT p_brand AS node, p_partkey AS id FROM part),
p AS (SELECT node, count(*) AS size FROM q GROUP BY 1), s AS (SELECT exam, seed, n, node, size, coalesce(sum(size - 1) OVER (PARTITION BY exam ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip, sum(size - 1) OVER (PARTITION BY exam) AS done FROM p, e),
x AS (SELECT s.*, id, row_number() OVER (PARTITION BY exam, q.node ORDER BY id) - 1 AS i FROM s JOIN q USING (node)),
y AS ({_RANDOM.format("(SELECT *, skip + size - i AS nth FROM x)")}),
o AS (SELECT exam, any_value(n) AS n, node, {_SWAPS.format("list(id ORDER BY i)", "list([CAST(i AS BIGINT), CAST(floor(r * (i + 1)) AS BIGINT)] ORDER BY i DESC)")} AS ids FROM y GROUP BY exam, node),
v AS (SELECT exam, seed, done, node, row_number() OVER (PARTITION BY exam ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY exam) AS size FROM s),
z AS ({_RANDOM.format("(SELECT *, done + size - i AS nth FROM v)")}),
t AS (SELECT exam, {_SWAPS.format("list(i ORDER BY i)", "list([CAST(i AS BIGINT), CAST(floor(r * (i + 1)) AS BIGINT)] ORDER BY i DESC)")} AS turn, list(node ORDER BY i) AS nodes FROM z GROUP BY 1),
l AS (SELECT exam, n, node, unnest(ids) AS id, generate_subscripts(ids, 1) AS round FROM o), m AS (SELECT exam, unnest(list_transform(turn, lambda k: nodes[k + 1])) AS node, generate_subscripts(turn, 1) AS turn FROM t)
SELECT exam, row_number() OVER (PARTITION BY exam ORDER BY round, turn) AS place, node, id FROM l JOIN m USING (exam, node) QUALIFY row_number() OVER (PARTITION BY exam ORDER BY round, turn) <= n""")
def seeded_exams(s: SparkSession, d: str) -> DataFrame:
    """An exam for each region's seed: parts of all brands in the seeded order, brand after brand in a seeded turn."""
    q = table(s, d, "part").select(F.col("p_brand").alias("node"), F.col("p_partkey").alias("id"))
    e = table(s, d, "region").select(F.col("r_regionkey").alias("exam"), (F.col("r_regionkey") * 1000 + 7).alias("seed"), (F.col("r_regionkey") + 40).alias("n"))
    return shuffles.exam(q, e).select("exam", F.col("place").cast("long").alias("place"), "node", "id")


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, list(event_id ORDER BY i) AS ids, list(value ORDER BY i) AS xs FROM o GROUP BY 1),
f AS (SELECT user_id, ids, list_reduce(list_prepend([[CAST(0 AS DOUBLE), 0]], list_transform(xs, lambda x: [[x, CASE WHEN x IS NULL THEN 0 ELSE 1 END]])), lambda a, x: list_append(a, [a[len(a)][1] * 0.75 + coalesce(x[1][1], 0), a[len(a)][2] * 0.75 + x[1][2]])) AS s FROM l)
SELECT user_id, unnest(ids) AS event_id, round(unnest(list_transform(s[2:], lambda y: CASE WHEN y[2] > 0 THEN y[1] / y[2] END)), 6) AS mean FROM f""")
def weighted_means(s: SparkSession, d: str) -> DataFrame:
    """The mean of each user's values so far, later ones weighing more."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "value")
    return recurrence.ewm(e, ["user_id"], ["ts", "event_id"], "value", 0.25).select("user_id", "event_id", F.round("ewm", 6).alias("mean"))
