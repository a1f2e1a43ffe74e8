"""Plans over ordered rows, parsers and learning content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import parse
from tessera.operators import flow, phrases
from tessera.plans.catalog import query
from tessera.session import table


_SHORT = "('" + "','".join(sorted(parse.ABBREVIATIONS)) + "')"


@query(rf"""WITH w AS (SELECT doc_id, lang, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents),
f AS (SELECT doc_id, w, list_transform(generate_series(1, len(w)), lambda i: CASE WHEN i = 1 THEN 0
  WHEN regexp_matches(w[i], '^[•▪◦‣●■▸►]$') AND i < len(w) THEN 1
  WHEN regexp_matches(w[i - 1], '[.!?…]["”'')\]]*$') AND lower(w[i - 1]) NOT IN {_SHORT} AND NOT regexp_matches(w[i - 1], '(^|[(\[«"''])[A-Z]\.$')
   AND regexp_matches(w[i], CASE lang WHEN 'fr' THEN '^[\p{{Lu}}0-9(\[«"“'']' WHEN 'es' THEN '^([\p{{Lu}}0-9(\[«"“'']|[¿¡]([^\p{{Ll}}]|$))' ELSE '^[A-Z0-9(\[«"“'']' END) THEN 1 ELSE 0 END) AS f FROM w),
n AS (SELECT doc_id, unnest(w) AS w, unnest(list_transform(generate_series(1, len(f)), lambda i: CAST(list_sum(f[1:i]) AS INTEGER))) AS n, unnest(generate_series(1, len(w))) AS i FROM f),
s AS (SELECT doc_id, n, string_agg(w, ' ' ORDER BY i) AS sentence FROM n GROUP BY ALL)
SELECT doc_id, n, CAST(length(sentence) AS INTEGER) AS chars, md5(sentence) AS digest FROM s WHERE sentence <> ''""")
def sentence_rows(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.posexplode(parse.sentences(F.col("text"), F.col("lang"))).alias("n", "sentence"))
    return x.select("doc_id", "n", F.length("sentence").alias("chars"), F.md5("sentence").alias("digest"))


_KEPT = {k: "('" + "','".join(v) + "')" for k, v in (("before", flow.KEEP_BEFORE), ("after", flow.KEEP_AFTER))}


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '-' || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, list_transform(generate_series(1, len(l)), lambda i: CASE WHEN i = len(l) THEN l[i]
  WHEN NOT regexp_matches(l[i], '[A-Za-z]-$') OR NOT regexp_matches(l[i + 1], '^[a-z]') THEN l[i] || ' '
  WHEN lower(regexp_extract(l[i], '([A-Za-z]+)-$', 1)) IN {_KEPT['before']} OR regexp_extract(l[i + 1], '^[a-z]+') IN {_KEPT['after']} THEN l[i]
  ELSE l[i][:-2] END) AS p FROM l)
SELECT doc_id, array_to_string(p, '') AS joined FROM p""")
def joined_lines(s: SparkSession, d: str) -> DataFrame:
    """All documents, with a hyphen and a line break after each sentence besides their own."""
    t = F.replace(F.col("text"), F.lit(". "), F.lit("-\n"))
    return table(s, d, "documents").select("doc_id", flow.join_lines(F.split(t, "\n")).alias("joined"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
c AS (SELECT source, doc_id, chars, r, chars AS total, 1 AS n, 0 AS chunk FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.doc_id, o.chars, o.r, CASE WHEN c.total + o.chars > 6000 OR c.n >= 20 THEN o.chars ELSE c.total + o.chars END, CASE WHEN c.total + o.chars > 6000 OR c.n >= 20 THEN 1 ELSE c.n + 1 END,
  CASE WHEN c.total + o.chars > 6000 OR c.n >= 20 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN o ON o.source = c.source AND o.r = c.r + 1)
SELECT source, doc_id, CAST(chars AS INTEGER) AS chars, chunk FROM c""")
def request_chunks(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("source", "doc_id", F.length("text").alias("chars"))
    return flow.chunks(x, "source", ["doc_id"], "chars", 6000, 20)


@query("""WITH e AS (SELECT user_id, epoch(ts) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e),
c AS (SELECT user_id, t, sum(CASE WHEN d > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT user_id, cluster, count(*) AS n, max(t) - min(t) AS span FROM c GROUP BY 1, 2""")
def session_clusters(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return flow.gap_clusters(e, "user_id", "t", 3600).groupBy("user_id", "cluster").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


@query("""WITH c AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS r, text FROM conversations),
p AS (SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS i FROM (SELECT DISTINCT conv_id, role FROM conversations)),
b AS (SELECT *, CASE i WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 6 END AS bits FROM p)
SELECT conv_id, role, r, row_number() OVER (PARTITION BY conv_id ORDER BY r, bits, role) AS turn FROM c JOIN b USING (conv_id, role)""")
def spread_turns(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")).alias("r"), F.lit(0).alias("load"))
    return flow.spread(c, "conv_id", "role", "load", "r").select("conv_id", "role", "r", "turn")


@query("SELECT event_id, props AS value, 'closed' AS repairs FROM events")
def repaired_props(s: SparkSession, d: str) -> DataFrame:
    """Event properties cut short before their end, parsed all the same."""
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return table(s, d, "events").select("event_id", parse.repaired_json(cut).alias("x")).select("event_id", "x.value", F.array_join("x.repairs", ",").alias("repairs"))


@query("SELECT p_size AS slot, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT i, 0 FROM generate_series(0, 59) g(i) WHERE i NOT IN (SELECT p_size FROM part)")
def box_histogram(s: SparkSession, d: str) -> DataFrame:
    return flow.dense_histogram(table(s, d, "part").select(F.col("p_size").alias("slot")), "slot", range(0, 60))


@query("""WITH a AS (SELECT o_custkey AS node, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS correct FROM orders GROUP BY 1)
SELECT node, total, correct, substr('▁▂▃▄▅▆▇█', CAST(floor(correct / total * 7 + 0.5) AS INTEGER) + 1, 1) AS bar, row_number() OVER (ORDER BY correct / total, total DESC, node) AS place FROM a""")
def weakest_nodes(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"))
    """Nodes by their rate, the lowest first; of equal ones the one with most answers. Rates are counted first, so places are
    found in each by itself."""
    a = a.withColumn("rate", F.col("correct") / F.col("total"))
    rates = a.groupBy("rate").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = a.join(rates.select("rate", before.alias("before")), "rate")
    place = F.col("before") + F.row_number().over(Window.partitionBy("rate").orderBy(F.desc("total"), "node"))
    return a.select("node", "total", "correct", flow.sparkline(F.col("rate")).alias("bar"), place.alias("place"))


@query("""WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS a, list_sort(list(DISTINCT CASE WHEN o_totalprice > 150000 THEN 'F' ELSE o_orderstatus END)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, a = b AS correct FROM o""")
def graded_sets(s: SparkSession, d: str) -> DataFrame:
    """Sets of three letters at most, so a group's set is small however many rows it has."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.when(F.col("o_totalprice") > 150000, "F").otherwise(F.col("o_orderstatus"))).alias("b"))
    return o.select("o_custkey", flow.grade_sets(F.col("a"), F.col("b")).alias("correct"))


@query(r"""WITH w AS (SELECT p_brand, unnest(list_filter(regexp_split_to_array(lower(p_name || ' glass classes bus ' || p_name || 's'), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part),
s AS (SELECT p_brand, CASE WHEN length(w) > 3 AND regexp_matches(w, '[^sui]s$') THEN w[:-2] ELSE w END AS stem FROM w)
SELECT stem, count(DISTINCT p_brand) > 1 AS ambiguous, count(DISTINCT p_brand) AS concepts FROM s GROUP BY 1""")
def ambiguous_stems(s: SparkSession, d: str) -> DataFrame:
    """Stems of part names, and whether they name several brands."""
    name = F.concat("p_name", F.lit(" glass classes bus "), "p_name", F.lit("s"))
    w = table(s, d, "part").select("p_brand", F.explode(phrases.stems(name)).alias("stem"))
    return phrases.ambiguous(w, "stem", "p_brand")


@query("SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^A-Za-z0-9 ]')) AS c FROM benchmark) GROUP BY 1")
def odd_characters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^A-Za-z0-9 ]"), F.lit(0))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
