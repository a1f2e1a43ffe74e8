"""Plans for search, keyed merges, dumps and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normal_answer, parse_number
from tessera.operators import evidence, flow, merge, passages, ranges, search
from tessera.plans.catalog import FOLD_SQL, query
from tessera.session import table


@query(f"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array({FOLD_SQL}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x = 'the')) AS n FROM documents) SELECT doc_id, n FROM w WHERE n > 0""")
def phrase_hits(s: SparkSession, d: str) -> DataFrame:
    return search.counted(table(s, d, "documents"), "the").select("doc_id", F.col("n").cast("long").alias("n"))


@query(f"""WITH f AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents) SELECT doc_id, hits[1] AS first, len(hits) AS n, len(hits) > 1000 AS truncated FROM (SELECT doc_id,
list_filter(generate_series(0, length(f) - 7), lambda i: f[i + 1:i + 7] = 'license' AND (i = 0 OR NOT regexp_matches(f[i:i], '[\\p{{L}}\\p{{N}}]'))) AS hits FROM f WHERE contains(f, 'license')) WHERE len(hits) > 0""")
def hit_groups(s: SparkSession, d: str) -> DataFrame:
    g = search.groups(search.hits(table(s, d, "documents"), "license"))
    return g.select("doc_id", F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n"), "truncated")


@query(f"""WITH t AS (SELECT doc_id, text, {FOLD_SQL} AS f FROM documents WHERE contains({FOLD_SQL}, 'general public license')),
p AS (SELECT *, unnest(list_filter(generate_series(0, length(f) - 22), lambda i: f[i + 1:i + 22] = 'general public license' AND (i = 0 OR NOT regexp_matches(f[i:i], '[\\p{{L}}\\p{{N}}]')))) AS pos FROM t),
l AS (SELECT *, regexp_extract(text[1:pos], '[^\\n]*$') AS b, regexp_extract(text[pos + 23:], '^[^\\n]*') AS a FROM p)
SELECT doc_id, pos AS at, CASE WHEN length(b) <= 40 THEN b ELSE regexp_extract(b, '[\\p{{L}}\\p{{N}}]*.{{40}}$') END || '[' || text[pos + 1:pos + 22] || ']' || CASE WHEN length(a) <= 40 THEN a ELSE regexp_extract(a, '^.{{40}}[\\p{{L}}\\p{{N}}]*') END AS snippet FROM l""")
def hit_snippets(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    return search.hits(docs, "General Public License").join(docs, "doc_id").select("doc_id", F.col("at").cast("long").alias("at"), search.snippet(F.col("text"), F.col("at"), F.col("len")).alias("snippet"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
h AS (SELECT doc_id, line, title, trim(regexp_replace({FOLD_SQL.replace("text", "title")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM l WHERE length(title) BETWEEN 3 AND 80 AND NOT regexp_matches(title, '[.!?:;,]\\s*$'))
SELECT *, count(*) OVER (PARTITION BY doc_id, k) >= 10 AS repeated FROM h WHERE k <> ''""")
def document_headings(s: SparkSession, d: str) -> DataFrame:
    return search.headings(table(s, d, "documents")).withColumn("line", F.col("line").cast("long"))


@query("SELECT d.doc_id, min(b.item_id) AS item_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def evidence_containment(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage."""
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = search.containing(table(s, d, "documents").select("doc_id", "text"), b, "doc_id", "item_id")
    return found.groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


@query("""WITH u AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS seen FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier) SELECT k, arg_max(v, seen) AS v, CAST(max(seen) AS INTEGER) AS seen FROM u GROUP BY 1""")
def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("seen"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit(1).alias("seen"))
    return merge.upsert(a, b, ["k"], "seen")


@query("SELECT c_custkey AS k, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS v, c_name AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def patch_fields(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"))
    return merge.patch(a, b, ["k"])


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'customer' AS name, count(*) AS removed FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (FROM gone) AND o_orderstatus <> 'F'""")
def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    o = table(s, d, "orders").withColumn("k", F.col("o_custkey"))
    return merge.cascade({"customer": c, "orders": o}, c.where("c_acctbal < 0").select("k"), "k", {"orders": F.col("o_orderstatus") == "F"})[1]


@query("""SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2""")
def merge_maps_max(s: SparkSession, d: str) -> DataFrame:
    """Two halves of each user's history as maps, merged by the greater value of each key: five keys a map."""
    e = table(s, d, "events")
    half = lambda when: e.where(when).groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    a, b = half("value >= 50"), half("value < 50 OR value IS NULL")
    j = a.withColumnRenamed("m", "a").join(b.withColumnRenamed("m", "b"), "user_id", "full")
    return j.select("user_id", F.explode(merge.max_maps(F.col("a"), F.col("b"))).alias("event_type", "v"))


@query("""WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT c_nationkey, min(c_custkey) AS id FROM c WHERE c_nationkey < 20 GROUP BY 1)
SELECT o_orderkey, coalesce(c.c_custkey, n.id) AS id, coalesce(c.c_custkey, n.id) IS NULL AS missing FROM orders JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN c ON o_custkey = c.c_custkey LEFT JOIN n ON a.c_nationkey = n.c_nationkey""")
def resolve_targets(s: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is gone go to the first customer with the same content hash (its nation's), if there is one."""
    every = table(s, d, "customer").withColumn("h", F.sha2(F.col("c_nationkey").cast("string"), 256))
    c = every.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("by_id"), F.when(F.col("c_nationkey") < 20, F.col("h")).alias("by_hash"))
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey").join(every.select(F.col("c_custkey").alias("o_custkey"), "h"), "o_custkey")
    return merge.resolve(rows, c, [("o_custkey", "by_id"), ("h", "by_hash")], "id").select("o_orderkey", "id", "missing")


@query("SELECT p_partkey, lower(replace(replace(p_name, ' ', ''), '''', '')) AS answer, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS num FROM part")
def normal_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", normal_answer(F.col("p_name")).alias("answer"), parse_number(F.concat(F.lit(" "), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("%"))).alias("num"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 50), d AS (SELECT a AS n FROM e UNION ALL SELECT -b FROM e)
SELECT n AS node, count(*) AS degree FROM d GROUP BY 1 ORDER BY degree DESC, node LIMIT 12""")
def graph_degrees(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return e.select(F.explode(F.array(F.col("a"), -F.col("b"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(12)


@query("""WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, CAST(o_orderpriority[1] AS INTEGER) AS lvl FROM orders)
SELECT doc, p, lvl, (SELECT min(n.p) - 1 FROM o n WHERE n.doc = o.doc AND n.p > o.p AND n.lvl <= o.lvl) AS until FROM o""")
def chapter_ranges(s: SparkSession, d: str) -> DataFrame:
    """A chapter ends before the next one of its level or above."""
    w = Window.partitionBy("doc").orderBy("at", "o_orderkey")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").alias("at"), "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("lvl"))
    o = o.withColumn("p", F.row_number().over(w).cast("long"))
    return ranges.until_same_level(o, "doc", "p", "lvl").select("doc", "p", "lvl", "until")


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS f FROM lineitem WHERE l_linenumber = 1), p AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS page FROM lineitem WHERE l_linenumber = 2)
SELECT k, page, (SELECT count(*) FROM h WHERE h.k = p.k AND h.f <= p.page) - 1 AS chapter, (SELECT max(f) FROM h WHERE h.k = p.k AND h.f <= p.page) AS lo, (SELECT min(f) - 1 FROM h WHERE h.k = p.k AND h.f > p.page) AS hi FROM p""")
def chapter_at(s: SparkSession, d: str) -> DataFrame:
    """Pages among chapters, which go from one heading to the next: -1 before the first."""
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("at"), "l_linenumber")
    p = x.where("l_linenumber = 2").select("k", F.col("at").alias("page")).distinct()
    return ranges.chapter_of(p, x.where("l_linenumber = 1").select("k", "at"), "k", "page", "at")


@query("""WITH l AS (SELECT source AS k, doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
p AS (SELECT k, page, page || ':' || pos AS para, pos, length(t) AS chars, (page * 7 + pos) % 3 AS sent, pos % 4 = 0 AS summarised, page % 5 <> 0 AND length(t) > 0 AS candidate FROM l),
load AS (SELECT k, page, sum(sent) AS load FROM p GROUP BY 1, 2),
c AS (SELECT *, sent * 2 + CASE WHEN summarised THEN 0 ELSE 1 END AS g FROM p WHERE candidate),
n AS (SELECT k, g, page, row_number() OVER (PARTITION BY k, g ORDER BY page) - 1 AS i FROM (SELECT DISTINCT k, g, page FROM c)),
o AS (SELECT c.k, c.para, c.page, c.chars, row_number() OVER (PARTITION BY c.k ORDER BY c.g, c.round, load, list_sum(list_transform(generate_series(0, 29), lambda b: CASE WHEN (i >> b) & 1 = 1 THEN pow(0.5, b + 1) ELSE 0 END)), i) AS pl
  FROM (SELECT *, row_number() OVER (PARTITION BY k, g, page ORDER BY pos) AS round FROM c) c JOIN n ON n.k = c.k AND n.g = c.g AND n.page = c.page JOIN load ON load.k = c.k AND load.page = c.page),
f AS (SELECT k, list_reduce(list_prepend({'used': CAST(0 AS BIGINT), 'took': CAST([] AS BIGINT[])}, list({'used': CAST(chars AS BIGINT), 'took': [pl]} ORDER BY pl)), lambda a, x: CASE WHEN a.used + x.used <= 6000 THEN {'used': a.used + x.used, 'took': list_concat(a.took, x.took)} ELSE a END) AS r, count(*) AS n FROM o GROUP BY 1),
t AS (SELECT k, n - len(r.took) AS "left", unnest(r.took) AS pl FROM f)
SELECT t.k, row_number() OVER w AS place, o.para, o.page, CAST(sum(o.chars) OVER w AS BIGINT) AS total, "left" FROM t JOIN o ON o.k = t.k AND o.pl = t.pl WINDOW w AS (PARTITION BY t.k ORDER BY t.pl)""")
def passages_within(s: SparkSession, d: str) -> DataFrame:
    """Lines of each source's documents to send next, 6,000 characters of them: those that do not fit are skipped."""
    lines = table(s, d, "documents").select(F.col("source").alias("k"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "t")).withColumn("pos", F.col("pos") + 1)
    p = lines.select(
        "k", "page", "pos", F.concat_ws(":", "page", "pos").alias("para"), F.length("t").alias("chars"), F.pmod(F.col("page") * 7 + F.col("pos"), F.lit(3)).alias("sent"), (F.col("pos") % 4 == 0).alias("summarised"),
        ((F.col("page") % 5 != 0) & (F.length("t") > 0)).alias("candidate"),
    )
    out = passages.chosen(passages.ordered(p, "k"), "k", 6000)
    return out.select("k", F.col("place").cast("long").alias("place"), "para", "page", "total", "left")


_WRITTEN = "replace(replace(replace({0}, 'm', 'ｍ'), 'e', 'e' || chr(173)), ' ', ' ' || chr(160))"


@query(f"""WITH h AS (SELECT doc_id, item_id, d.text, b.text AS q, strpos(d.text, b.text) AS pl FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT doc_id AS para, item_id AS quote_id, 'exact' AS how, length({_WRITTEN.format("substr(text, 1, pl - 1)")}) AS start, length({_WRITTEN.format("substr(text, 1, pl - 1) || q")}) - CAST(ends_with(q, 'e') AS INTEGER) AS "end" FROM h""")
def quote_offsets(s: SparkSession, d: str) -> DataFrame:
    """Where benchmark passages stand in documents that are written with wide letters, soft hyphens and doubled blanks."""
    t = F.replace(F.replace(F.replace("text", F.lit("m"), F.lit("ｍ")), F.lit("e"), F.lit("e\u00ad")), F.lit(" "), F.lit(" \u00a0"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("para"), t.alias("text"))
    b = table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    p = evidence.places(docs, b)
    return p.select("para", "quote_id", "how", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH f AS (SELECT doc_id, source, lang, {FOLD_SQL} AS f FROM documents),
u AS (SELECT doc_id, source, lang, unnest(string_split(f, 'de')) AS t, generate_subscripts(string_split(f, 'de'), 1) AS j, len(string_split(f, 'de')) AS parts FROM f WHERE contains(f, 'de')),
w AS (SELECT *, CAST(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY j) - 2 AS BIGINT) AS pl, lead(t) OVER (PARTITION BY doc_id ORDER BY j) AS nx FROM u),
h AS (SELECT * FROM w WHERE j < parts AND NOT (t = '' AND j > 1) AND NOT (nx = '' AND j + 1 < parts) AND NOT regexp_matches(right(t, 1), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(left(nx, 1), '[\\p{{L}}\\p{{N}}]')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pl) AS r, count(*) OVER (PARTITION BY source) AS n FROM h)
SELECT source, lang, doc_id, count(*) AS hits, min(pl) AS first, n > 1000 AS truncated FROM r WHERE r <= 1000 GROUP BY source, lang, doc_id, n""")
def hits_by_kind(s: SparkSession, d: str) -> DataFrame:
    """The first 1,000 hits of each source, by kind (language) and page (document), and whether there were more. Documents are
    counted first; only those that begin under the limit give their hits."""
    docs = table(s, d, "documents")
    n = search.counted(docs.select("doc_id", "text"), "de").join(docs.select("doc_id", "source", "lang"), "doc_id")
    total = n.groupBy("source").agg(F.sum("n").alias("_all"))
    near = flow.running(n, "source", "doc_id", "n", search.HITS).withColumn("h", F.expr(f"slice(h, 1, int({search.HITS} - before))"))
    g = near.join(total, "source").select("source", "lang", "doc_id", F.size("h").cast("long").alias("hits"), F.get("h", F.lit(0))["at"].cast("long").alias("first"), (F.col("_all") > search.HITS).alias("truncated"))
    return g
