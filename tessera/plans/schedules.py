"""Plans over histories: ranges, learning schedules, usage, reading time, retention, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates, text as T
from tessera.operators import flow, learning, ranges
from tessera.plans.catalog import query
from tessera.session import table

_ISLANDS = """r AS (SELECT DISTINCT k, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM src),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM m),
u AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, isl)"""


def _ranges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_linenumber")).alias("hi"))


@query(f"WITH src AS (SELECT l_suppkey AS k, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem), {_ISLANDS} SELECT * FROM u")
def ranges_union(s: SparkSession, d: str) -> DataFrame:
    return ranges.union(_ranges(s, d), "k", "lo", "hi")


@query(f"WITH src AS (SELECT l_suppkey AS k, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem), {_ISLANDS} SELECT k, sum(hi - lo + 1) AS n FROM u GROUP BY 1")
def ranges_length(s: SparkSession, d: str) -> DataFrame:
    return ranges.length(_ranges(s, d), "k")


@query(f"""WITH src AS (SELECT l_suppkey AS k, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem), {_ISLANDS},
p AS (SELECT k, unnest(generate_series(lo, hi)) AS p FROM u), q AS (SELECT DISTINCT l_suppkey AS k, l_partkey + 1 AS p FROM lineitem WHERE l_quantity > 25),
x AS (SELECT * FROM p EXCEPT SELECT * FROM q), g AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM x)
SELECT k, min(p) AS lo, max(p) AS hi FROM g GROUP BY k, g""")
def ranges_subtract(s: SparkSession, d: str) -> DataFrame:
    cut = table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") + 1).alias("lo"), (F.col("l_partkey") + 1).alias("hi"))
    return ranges.subtract(_ranges(s, d), cut, "k")


@query("""SELECT DISTINCT o_custkey AS k, o_orderkey AS p, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = o_custkey AND o_orderkey BETWEEN l_partkey AND l_partkey + l_linenumber) AS inside FROM orders""")
def ranges_contain(s: SparkSession, d: str) -> DataFrame:
    points = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"))
    return ranges.contains(points, _ranges(s, d), "k", "p")


@query("""WITH a AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
l AS (SELECT user_id, max(CASE WHEN NOT ok THEN (ts, event_id) END) AS w, max(ts) AS last, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong FROM a GROUP BY 1),
b AS (SELECT l.user_id, correct, wrong, last, least(4, 1 + (SELECT count(*) FROM a WHERE a.user_id = l.user_id AND ok AND (w IS NULL OR (ts, event_id) > w))) AS box FROM l)
SELECT user_id, CAST(box AS INTEGER) AS box, correct, wrong, CAST(CASE box WHEN 1 THEN CAST(last AS DATE) + 1 WHEN 2 THEN CAST(last AS DATE) + 3 WHEN 3 THEN CAST(last AS DATE) + 7 END AS VARCHAR) AS due FROM b""")
def leitner_boxes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return learning.boxes(e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("correct")))


def _grades(s: SparkSession, d: str) -> DataFrame:
    v = F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(4))
    return table(s, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(v == 0, "again").when(v == 1, "hard").when(v == 2, "good").otherwise("easy").alias("grade"))


@query("""WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE ((CAST(floor(value * 100) AS BIGINT) % 4) + 4) % 4 WHEN 0 THEN 'again' WHEN 1 THEN 'hard' WHEN 2 THEN 'good' ELSE 'easy' END AS grade FROM events WHERE user_id IS NOT NULL),
x AS (SELECT *, CASE grade WHEN 'again' THEN -0.2::DOUBLE WHEN 'hard' THEN -0.15::DOUBLE WHEN 'good' THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END AS delta FROM g),
s AS (SELECT user_id, 0::BIGINT AS r, 2.5::DOUBLE AS ease, 0::BIGINT AS days, 0::BIGINT AS reps, 0::BIGINT AS lapses FROM g GROUP BY user_id
  UNION ALL SELECT user_id, r, ease, CASE WHEN grade = 'again' THEN 0 ELSE least(365, CASE WHEN reps = 0 THEN CASE grade WHEN 'easy' THEN 4 ELSE 1 END WHEN grade = 'good' AND reps = 1 THEN 6
      ELSE greatest(CASE WHEN grade = 'easy' AND reps = 1 THEN 7 ELSE 0 END, days + 1, CAST(floor(days * CASE grade WHEN 'hard' THEN 1.2::DOUBLE WHEN 'good' THEN ease ELSE ease * 1.3::DOUBLE END + 0.5::DOUBLE) AS BIGINT)) END) END,
    CASE WHEN grade = 'again' THEN 0 ELSE reps + 1 END, lapses + CASE WHEN grade = 'again' THEN 1 ELSE 0 END
  FROM (SELECT s.user_id, x.r, x.grade, greatest(1.3::DOUBLE, floor((s.ease + x.delta) * 100 + 0.5::DOUBLE) / 100) AS ease, s.days, s.reps, s.lapses FROM s JOIN x ON x.user_id = s.user_id AND x.r = s.r + 1))
SELECT user_id, ease, days, reps, lapses FROM s QUALIFY r = max(r) OVER (PARTITION BY user_id)""")
def spaced_schedule(s: SparkSession, d: str) -> DataFrame:
    return learning.schedule(_grades(s, d))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def daily_usage(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, CASE WHEN sum(value) >= 100 THEN round(count(*) / sum(value) * 10000, 6) END AS per_10k, CAST(floor(avg(value) + 0.5) AS BIGINT) AS mean FROM events GROUP BY 1")
def calls_per_10k(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.when(F.sum("value") >= 100, F.round(F.count("*") / F.sum("value") * 10000, 6)).alias("per_10k"), F.floor(F.avg("value") + 0.5).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
c AS (SELECT user_id, ts AS a, least(nx, ts + INTERVAL 120 SECOND) AS b FROM g WHERE nx IS NOT NULL),
p AS (SELECT user_id, a, least(b, date_trunc('day', a) + INTERVAL 1 DAY) AS b FROM c UNION ALL SELECT user_id, date_trunc('day', b), b FROM c WHERE date_trunc('day', b) > date_trunc('day', a))
SELECT user_id, CAST(CAST(a AS DATE) AS VARCHAR) AS day, CAST(sum(epoch_us(b) - epoch_us(a)) AS BIGINT) AS us FROM p GROUP BY 1, 2 HAVING sum(epoch_us(b) - epoch_us(a)) > 0""")
def reading_time(s: SparkSession, d: str) -> DataFrame:
    """Time between a user's events, 120 s at most for each gap, split at midnight."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = table(s, d, "events").select("user_id", F.col("ts").alias("a"), F.lead("ts").over(w).alias("nx")).where("nx IS NOT NULL")
    c = g.select("user_id", "a", F.least("nx", F.expr("a + INTERVAL 120 SECONDS")).alias("b"))
    night = F.date_trunc("day", "b")
    parts = F.when(night > F.date_trunc("day", "a"), F.array(F.struct(F.col("a"), night.alias("b")), F.struct(night.alias("a"), F.col("b")))).otherwise(F.array(F.struct("a", "b")))
    p = c.select("user_id", F.inline(parts))
    return p.groupBy("user_id", F.to_date("a").cast("string").alias("day")).agg(F.sum(F.unix_micros("b") - F.unix_micros("a")).alias("us")).where("us > 0")


@query("""WITH p AS (SELECT doc_id, source, length(text) AS n FROM documents), c AS (SELECT source, doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS before FROM p)
SELECT source, doc_id FROM c WHERE before < 20000""")
def todays_pages(s: SparkSession, d: str) -> DataFrame:
    """In order, documents of each source until 20,000 characters are reached."""
    x = table(s, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return flow.running(x, "source", "doc_id", "n", 20000).select("source", "doc_id")


@query("""WITH o AS (SELECT doc_id, source, length(text) AS bytes FROM documents), r AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM o)
SELECT source, count(*) AS n, sum(bytes) AS bytes FROM r WHERE kept <= 50000 GROUP BY 1""")
def cache_eviction(s: SparkSession, d: str) -> DataFrame:
    """The newest entries that fit a byte limit; older ones are evicted."""
    o = table(s, d, "documents").select("source", "doc_id", F.length("text").alias("bytes"))
    kept = flow.running(o, "source", "doc_id", "bytes", 50001, descending=True).where("before + bytes <= 50000")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders) SELECT o_orderkey, CAST(day AS VARCHAR) AS day, day - DATE '1970-01-01' AS n, dayofweek(day) AS weekday,
(SELECT count(*) FROM generate_series(0, CAST(DATE '2000-01-01' - day AS BIGINT) - 1) g(i) WHERE dayofweek(day + CAST(i AS INTEGER)) IN (1, 3, 5)) AS study FROM d""")
def study_calendar(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    n = dates.day_number(F.col("day"))
    exam = dates.day_number(F.lit("2000-01-01"))
    return o.select("o_orderkey", dates.day_key(n).alias("day"), n.cast("long").alias("n"), dates.weekday(n).cast("long").alias("weekday"), dates.study_days(n, exam, [1, 3, 5]).alias("study"))


@query("SELECT o_orderkey, floor(o_totalprice * 10 + 0.5) / 10 AS r FROM orders")
def round_half_up(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", T.round_half_up(F.col("o_totalprice"), 1).alias("r"))


@query("""WITH mine AS (SELECT o_custkey AS k, max(o_totalprice) AS v, max(o_orderdate) AS at, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
theirs AS (SELECT o_custkey AS k, max(o_totalprice) AS v, max(o_orderdate) AS at, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(m.k, t.k) AS k, CASE WHEN m.k IS NULL THEN 'add' WHEN t.k IS NULL OR t.at <= m.at THEN 'keep' ELSE 'put' END AS op, CASE WHEN m.k IS NULL OR t.at > m.at THEN t.v ELSE m.v END AS v, greatest(m.n, t.n) AS n
FROM mine m FULL JOIN theirs t ON m.k = t.k""")
def merge_latest_wins(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    side = lambda x, p: o.where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias(p + "v"), F.max("o_orderdate").alias(p + "at"), F.count("*").alias(p + "n"))
    j = side("F", "m").join(side("O", "t"), "k", "full")
    newer = F.col("mn").isNull() | (F.col("tat") > F.col("mat"))
    return j.select("k", F.when(F.col("mn").isNull(), "add").when(newer, "put").otherwise("keep").alias("op"), F.when(newer, F.col("tv")).otherwise(F.col("mv")).alias("v"), F.greatest("mn", "tn").alias("n"))


@query("""SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""")
def backfill_plan(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT user_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def latest_twenty(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 20").drop("r")


@query("""SELECT doc_id, CASE WHEN q IS NULL THEN 'none' WHEN q = 1 AND t = 0 THEN 'done' ELSE 'learning' END AS status FROM (SELECT d.doc_id, max(quality) AS q, max(toxic) AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)""")
def node_status(s: SparkSession, d: str) -> DataFrame:
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    j = table(s, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("q").isNull(), "none").when((F.col("q") == 1) & (F.col("t") == 0), "done").otherwise("learning").alias("status"))


@query("""WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS r FROM part)
SELECT p_partkey FROM t ORDER BY r, p_brand LIMIT 60""")
def stratified_exam(s: SparkSession, d: str) -> DataFrame:
    """Round-robin over brands in an order that is random but repeatable."""
    w = Window.partitionBy("p_brand").orderBy(F.md5(F.col("p_partkey").cast("string")))
    return table(s, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("r")).orderBy("r", "p_brand").limit(60).select("p_partkey")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_type, count(*) AS n FROM e WHERE p IS DISTINCT FROM event_type GROUP BY 1, 2""")
def consecutive_dedupe(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("p", F.lag("event_type").over(w))
    return e.where(~F.col("event_type").eqNullSafe(F.col("p"))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
