"""Plans over a learner's progress: loading, merging, logs, exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import progress
from tessera.plans.catalog import query
from tessera.session import table

#: A progress record as JSON text for each customer, in words that both engines read; some are no records.
_RECORD = """CASE WHEN c_nationkey = 3 THEN 'not json' WHEN c_nationkey = 4 THEN '{"version": "1", "quiz": {}}' WHEN c_nationkey = 5 THEN '{"version": 2}' WHEN c_nationkey = 6 THEN ' '
ELSE concat('{"version": 1, "quiz": {"q', c_custkey, '": {"box": ', c_nationkey % 4 + 1, ', "due": "2024-01-0', c_nationkey % 9 + 1, '", "correct": ', c_nationkey, '}, "bad": {"box": "x"}, "odd": 7, "n": {"box": 2, "due": 5, "wrong": "no"}}}') END"""


@query("""SELECT c_custkey AS k, 'q' || c_custkey AS id, CAST(c_nationkey % 4 + 1 AS INTEGER) AS box, '2024-01-0' || (c_nationkey % 9 + 1) AS due, c_nationkey AS correct, 0 AS wrong FROM customer WHERE c_nationkey NOT IN (3, 4, 5, 6)
UNION ALL SELECT c_custkey, 'n', 2, NULL, 0, 0 FROM customer WHERE c_nationkey NOT IN (3, 4, 5, 6) UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_nationkey IN (3, 4, 5)""")
def progress_loaded(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(_RECORD).alias("value"))
    rows, aside = progress.loaded(raw, "k")
    return rows.unionByName(aside.select("k"), allowMissingColumns=True)


def _copies(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders")
    side = lambda x: o.where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("at"))
    return side("F"), side("O")


@query("""WITH m AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, strftime(max(o_orderdate), '%Y-%m-%d') AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, strftime(max(o_orderdate), '%Y-%m-%d') AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(m.k, n.k) AS k, CASE WHEN m.k IS NULL OR n.t > m.t THEN n.v ELSE m.v END AS v, CASE WHEN m.k IS NULL OR n.t > m.t THEN n.t ELSE m.t END AS "at", m.k IS NULL OR coalesce(n.t > m.t, false) AS theirs FROM m FULL JOIN n ON m.k = n.k""")
def progress_newest(s: SparkSession, d: str) -> DataFrame:
    return progress.newest(*_copies(s, d), ["k"], "at")


@query("SELECT o_custkey AS k, strftime(min(m), '%Y-%m-%d') AS \"at\" FROM (SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey, o_orderstatus) GROUP BY 1")
def cards_earliest(s: SparkSession, d: str) -> DataFrame:
    return progress.earliest(*_copies(s, d), ["k"], "at")


@query("""WITH e AS (SELECT user_id AS k, event_id % 500 AS id, value AS v, ts, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 END AS side, row_number() OVER (PARTITION BY user_id, event_id % 500, event_type ORDER BY event_id) AS r FROM events WHERE event_type IN ('error', 'purchase')),
o AS (SELECT * FROM e WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY side) = 1) SELECT k, id, v FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, id) <= 20""")
def exams_merged(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 500).alias("id"), "event_id", F.col("value").alias("v"), F.col("ts").alias("at"), "event_type")
    side = lambda x: e.where(F.col("event_type") == x).groupBy("k", "id").agg(F.min(F.struct("event_id", "v", "at")).alias("x")).select("k", "id", "x.v", "x.at")
    return progress.latest_union(side("error"), side("purchase"), ["k"], "id", "at").select("k", "id", "v")


@query("""SELECT l_suppkey AS k, l_partkey AS id, bool_or(l_returnflag = 'A') AS solved, bool_or(l_linestatus = 'F') AS gave_up, count(*) AS attempts, strftime(max(l_shipdate), '%Y-%m-%d') AS "at" FROM lineitem GROUP BY 1, 2""")
def practice_attempts(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "A").alias("solved"), (F.col("l_linestatus") == "F").alias("gave_up"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    return progress.attempts(log, ["k", "id"])


@query("""SELECT o_custkey AS k, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) < DATE '1996-06-01', CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1996-06-01' THEN o_orderdate END, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders""")
def exam_order(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return progress.exam_order(o, "k", "day", "id", F.lit("1996-06-01").cast("date")).select("k", "id", "place")


@query("""WITH g AS (SELECT l_suppkey AS k, p_brand AS node, count(*) AS questions, sum(l_quantity) AS wrong FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY wrong DESC, CAST(regexp_extract(node, '[0-9]+') AS INTEGER)) AS INTEGER) AS place FROM g""")
def wrong_notes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("node"))
    a = table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("k"), "node", (F.col("l_returnflag") != "R").alias("last"), F.col("l_quantity").alias("wrong"))
    nodes = p.select("node").distinct().withColumn("order", F.regexp_extract("node", "[0-9]+", 0).cast("int"))
    return progress.wrong_by_node(a, nodes, "k")


@query("""WITH c AS (SELECT c_nationkey AS p, CASE WHEN count(o_orderkey) = 0 THEN 'empty' WHEN count(*) FILTER (o_orderstatus = 'F') * 2 >= count(*) THEN 'done' WHEN bool_or(o_orderstatus = 'P') THEN 'learning' ELSE 'none' END AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey)
SELECT p, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s <> 'empty') AS total, bool_or(s = 'learning') AS active FROM c GROUP BY 1""")
def group_status(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    c = table(s, d, "customer").join(o, "c_custkey", "left")
    status = F.when(F.col("n").isNull(), "empty").when(F.col("f") * 2 >= F.col("n"), "done").when(F.col("p"), "learning").otherwise("none")
    return progress.group_status(c.select(F.col("c_nationkey").alias("p"), status.alias("status")), "p")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 9 + 1 AS k FROM orders)
SELECT o_orderkey, CAST(list_filter(generate_series(0, 30), lambda i: dayofweek(day + CAST(i AS INTEGER)) IN (1, 3, 5))[k] + (day - DATE '1970-01-01') AS BIGINT) AS nth,
CAST(list_filter(generate_series(0, 70), lambda i: dayofweek(day + CAST(i AS INTEGER)) = 0)[k] + (day - DATE '1970-01-01') AS BIGINT) AS sunday FROM d""")
def nth_study_day(s: SparkSession, d: str) -> DataFrame:
    n = dates.day_number(F.date_format("o_orderdate", "yyyy-MM-dd"))
    k = F.col("o_orderkey") % 9 + 1
    return table(s, d, "orders").select("o_orderkey", progress.nth_study_day(n, k, [1, 3, 5]).alias("nth"), progress.nth_study_day(n, k, [0]).alias("sunday"))


@query("""WITH l AS (SELECT DISTINCT user_id AS k, CAST(ts AS DATE) AS day FROM events) SELECT k, strftime(day, '%Y-%m-%d') AS day, 'kept' AS what FROM l WHERE day >= DATE '2024-01-20' - 6
UNION ALL SELECT k, strftime(day, '%Y-%m-%d'), 'stale' FROM l WHERE day < DATE '2024-01-20' - 9""")
def log_retention(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).distinct()
    today = F.lit("2024-01-20").cast("date")
    out = lambda df, what: df.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), F.lit(what).alias("what"))
    return out(progress.kept_days(log, "day", today, 7), "kept").unionByName(out(progress.stale_days(log, "day", today, 9), "stale"))


@query("""WITH g AS (SELECT user_id AS k, count(*) AS due, count(*) FILTER (event_type = 'purchase') AS n, coalesce(sum(value * 1000) FILTER (event_type = 'purchase'), 0) AS ms FROM events GROUP BY 1)
SELECT k, CAST(ceil(due * CASE WHEN n > 0 AND ms > 0 THEN ms / n ELSE 8000.0 END / 60000.0) AS BIGINT) AS minutes FROM g""")
def review_minutes(s: SparkSession, d: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    g = table(s, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("due"), F.count_if(bought).alias("n"), F.coalesce(F.sum(F.when(bought, F.col("value") * 1000)), F.lit(0.0)).alias("ms"))
    return g.select("k", progress.review_minutes(F.col("due"), F.col("ms"), F.col("n")).alias("minutes"))


@query("""WITH r AS (SELECT user_id AS k, CASE event_type WHEN 'view' THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE event_type WHEN 'error' THEN 'src' WHEN 'purchase' THEN 'both' WHEN 'signup' THEN 'tr' ELSE 'x' END AS bucket, value - 20 AS ms, event_id % 7 - 1 AS chars FROM events)
SELECT k, day, bucket, round(sum(greatest(coalesce(ms, 0), 0)), 4) AS ms, sum(greatest(chars, 0)) AS chars, count(*) AS pages FROM r WHERE day <> 'yesterday' AND bucket <> 'x' GROUP BY 1, 2, 3""")
def reading_log(s: SparkSession, d: str) -> DataFrame:
    e, t = table(s, d, "events"), F.col("event_type")
    mode, both = F.when(t.isin("purchase", "signup"), "speak").when(t == "error", "show"), t != "signup"
    r = e.select(F.col("user_id").alias("k"), F.when(t == "view", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.when(mode.isNotNull(), progress.bucket_for(mode, both)).otherwise("x").alias("bucket"), (F.col("value") - 20).alias("ms"), (F.col("event_id") % 7 - 1).alias("chars"), F.lit(1).alias("pages"))
    return progress.reading_log(r, ["k"]).withColumn("ms", F.round("ms", 4))


@query("""SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN o_totalprice / 1000 ELSE 1.7 END AS rate, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 20 ELSE greatest(0, least(100, floor(o_totalprice / 2000) - 10)) END AS INTEGER) AS cards,
CAST(greatest(1, ceil(o_orderkey % 50 * 0.8 - 1e-9)) AS BIGINT) AS warn, CAST(DATE '1998-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days, DATE '1998-01-01' - CAST(o_orderdate AS DATE) > 30 AS stale,
CAST(greatest(0, ceil((o_orderkey * 100 + 60000 - 300000) / 1000.0)) AS BIGINT) AS "left" FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'""")
def planner_numbers(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where("o_orderdate <= timestamp'1998-01-01'")
    days, stale = progress.backup_age(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"))
    bucket = F.when(F.col("o_orderstatus") == "F", "src").otherwise("both")
    measured = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 1000)
    setting = F.when(F.col("o_orderkey") % 4 == 0, "many").otherwise((F.floor(F.col("o_totalprice") / 2000) - 10).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("k"), progress.calls_rate(measured, bucket).alias("rate"), progress.new_per_day(setting).alias("cards"), progress.warn_threshold(F.col("o_orderkey") % 50, F.lit(0.8)).alias("warn"),
        days.alias("days"), stale.alias("stale"), progress.countdown(F.col("o_orderkey") * 100, F.lit(60), F.lit(300000)).alias("left"),
    )
