"""Plans of study: what is left, speed, status, queues, samples, robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import study
from tessera.plans.catalog import query
from tessera.session import table


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS page, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS c FROM lineitem),
m AS (SELECT *, coalesce(c, avg(c) OVER (PARTITION BY k), 1800.0) AS x FROM p), r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS page FROM lineitem WHERE l_linestatus = 'F')
SELECT k, CAST(floor(sum(x) + 0.5) AS BIGINT) AS total, CAST(floor(coalesce(sum(x) FILTER (EXISTS (SELECT 1 FROM r WHERE r.k = m.k AND r.page = m.page)), 0) + 0.5) AS BIGINT) AS done,
greatest(0, CAST(floor(sum(x) + 0.5) AS BIGINT) - CAST(floor(coalesce(sum(x) FILTER (EXISTS (SELECT 1 FROM r WHERE r.k = m.k AND r.page = m.page)), 0) + 0.5) AS BIGINT)) AS "left" FROM m GROUP BY 1""")
def remaining_pages(s: SparkSession, d: str) -> DataFrame:
    """The SQL adds doubles as rows come: those of a key are added in their order in the table, as it does on one thread."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("chars"), "l_linestatus", *at)
    return study.remaining(p.drop("l_linestatus"), p.where("l_linestatus = 'F'").select("k", "page"), "k", ["file", "row"])


@query("""WITH g AS (SELECT user_id, sum(value) * 10000 AS ms, count(*) * 1000 AS chars FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' AND CAST(ts AS DATE) > DATE '2024-01-06' GROUP BY 1)
SELECT user_id, round(CASE WHEN ms >= 1800000 THEN chars / (ms / 60000.0) ELSE 840.0 END, 6) AS cpm, ms >= 1800000 AS measured FROM g""")
def reading_speed(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("value") * 10000).alias("ms"), F.lit(1000).alias("chars"))
    return study.speed(log, "user_id", F.lit("2024-01-20").cast("date")).withColumn("cpm", F.round("cpm", 6))


@query("""WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) - 100000 AS l, count(*) * 2 AS days FROM orders GROUP BY 1)
SELECT k, CASE WHEN l <= 0 THEN 'done' WHEN days - ceil(l / 70000.0) < 0 THEN 'short' WHEN days - ceil(l / 70000.0) < 2 THEN 'tight' ELSE 'ok' END AS status FROM o""")
def plan_status(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.sum("o_totalprice") - 100000).alias("l"), (F.count("*") * 2).alias("days"))
    return o.select("k", study.plan_status(F.col("l"), F.col("days"), F.lit(70000.0)).alias("status"))


_CARDS = "SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS created, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 30 DAY END AS due_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS reviewed_at, o_orderpriority = '1-URGENT' AS suspended FROM orders"


@query(f"""WITH c AS ({_CARDS}), n AS (SELECT *, reviewed_at IS NULL AS new FROM c WHERE NOT suspended),
q AS (SELECT *, row_number() OVER (PARTITION BY k, new ORDER BY CASE WHEN NOT new THEN due_at END, created, id) AS r FROM n WHERE new OR due_at < TIMESTAMP '1996-01-01')
SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY new, r) AS place FROM q WHERE NOT new OR r <= 3""")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    when = F.col("o_orderdate")
    c = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), when.alias("created"), F.when(F.col("o_orderstatus") != "P", F.expr("o_orderdate + INTERVAL 30 DAYS")).alias("due_at"), F.when(F.col("o_orderstatus") == "F", when).alias("reviewed_at"), F.lit(0).alias("reps"), (F.col("o_orderpriority") == "1-URGENT").alias("suspended"))
    return study.queue(c, "k", F.lit("1996-01-01").cast("timestamp"), 3).select("k", "id", "place")


@query("""SELECT o_custkey AS k, o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderstatus = 'F' END AS "last",
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 2 ELSE 1 END, md5('7:' || o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders""")
def session_order(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("last"))
    return study.session_order(q, "k", 7)


@query("""WITH a AS (SELECT o_orderkey, CAST((o_orderkey + 1831565813) % 4294967296 AS HUGEINT) AS a FROM orders), t AS (SELECT *, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t FROM a),
u AS (SELECT *, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296) AS u FROM t) SELECT o_orderkey, round(CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296, 12) AS r FROM u""")
def seeded_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.round(study.mulberry32("o_orderkey"), 12).alias("r"))


@query("""WITH n AS (SELECT o_custkey AS k, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1)
SELECT k, CASE WHEN n <= 12 THEN generate_series(1, n) ELSE list_sort(list_distinct(list_transform(generate_series(0, 11), lambda i: greatest(1, least(n, CAST(floor(1e-1 * n + (9e-1 * n - 1e-1 * n) * (i + 5e-1) / 12e0 + 5e-1) AS INTEGER)))))) END AS pages FROM n""")
def page_probes(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("int").alias("n"))
    return n.select("k", study.probes(F.col("n")).alias("pages"))


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY 1) SELECT p.p_brand, round(max(med), 6) AS "median", round(median(abs(p_retailprice - med)), 6) AS mad FROM part p JOIN m USING (p_brand) GROUP BY 1""")
def median_deviation(s: SparkSession, d: str) -> DataFrame:
    return study.mad(table(s, d, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""WITH n AS (SELECT p_type, floor(p_retailprice / 10 + 0.5) AS v, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, CAST(arg_min(v, (-n, v)) AS BIGINT) AS "mode" FROM n GROUP BY 1""")
def rounded_mode(s: SparkSession, d: str) -> DataFrame:
    return study.mode(table(s, d, "part"), "p_type", F.floor(F.col("p_retailprice") / 10 + 0.5)).select("p_type", "mode")


@query("""WITH e AS (SELECT DISTINCT l_returnflag AS g, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey AND l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier)),
d AS (SELECT g, n, count(*) AS c FROM (SELECT g, a AS n FROM e UNION ALL SELECT g, b FROM e) GROUP BY 1, 2), t AS (SELECT g, n FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY c DESC, n) <= 12)
SELECT g AS graph, a, b FROM e WHERE (g, a) IN (SELECT (g, n) FROM t) AND (g, b) IN (SELECT (g, n) FROM t)""")
def diagram_edges(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").select(F.col("l_returnflag").alias("graph"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    n = table(s, d, "supplier").select(F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("graph"), F.col("s_suppkey").alias("id"))
    return study.valid_edges(n, e)


@query(r"""WITH t AS (SELECT doc_id, CASE lang WHEN 'de' THEN replace(text, 'e', chr(65533)) WHEN 'fr' THEN replace(text, 'e', chr(57344)) ELSE text END AS t FROM documents),
c AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '\s', '', 'g')) AS chars, length(t) - length(replace(replace(t, chr(65533), ''), chr(57344), '')) AS bad FROM t)
SELECT doc_id, chars, bad, CASE WHEN n = 0 THEN 'notext' WHEN chars >= 50 AND bad * 5 >= chars THEN 'garbled' WHEN n < 200 THEN 'scan' ELSE 'text' END AS verdict FROM c""")
def scan_verdicts(s: SparkSession, d: str) -> DataFrame:
    """German and French documents with broken letters in place of every e."""
    from tessera.functions.text import garble

    t = F.when(F.col("lang") == "de", F.replace("text", F.lit("e"), F.lit("�"))).when(F.col("lang") == "fr", F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text"))
    x = table(s, d, "documents").select("doc_id", t.alias("t"))
    chars, bad = garble(F.col("t"))
    n = F.length("t")
    return x.select("doc_id", chars.alias("chars"), bad.alias("bad"), F.when(n == 0, "notext").when((chars >= 50) & (bad * 5 >= chars), "garbled").when(n < 200, "scan").otherwise("text").alias("verdict"))
