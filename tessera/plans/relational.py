"""Relational plans: joins, grouping, windows, set operations, reshaping, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import quantiles as exact_quantiles
from tessera.plans.catalog import query
from tessera.session import table


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")
def filter_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_totalprice >= 100000 AND o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1 HAVING count(*) >= 40 ORDER BY mean_price DESC, o_orderpriority LIMIT 1")
def having_top_mean(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return g.where("n >= 40").orderBy(F.desc("mean_price"), "o_orderpriority").limit(1)


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join_count(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def left_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_name").join(table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def left_semi(s: SparkSession, d: str) -> DataFrame:
    big = table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_counts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    j = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("k", F.lit(0)).alias("n_orders"), F.coalesce(F.round("t", 2), F.lit(0.0)).alias("total"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def full_outer(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_cust"))
    b = table(s, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supp"))
    return a.join(b, "k", "full").select("k", "n_cust", "n_supp")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_pairs(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_n_per_group(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
r AS (SELECT *, avg(v) OVER w AS m, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id, round(max(m), 4) AS best FROM r WHERE n = 7 GROUP BY 1""")
def rolling_mean_full_frames(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-6, 0)
    return t.withColumn("m", F.avg("v").over(w)).withColumn("n", F.count("*").over(w)).where("n = 7").groupBy("user_id").agg(F.round(F.max("m"), 4).alias("best"))


@query("SELECT p_partkey, p_retailprice FROM part QUALIFY p_retailprice > avg(p_retailprice) OVER (PARTITION BY p_brand)")
def above_partition_mean(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return p.withColumn("m", F.avg("p_retailprice").over(Window.partitionBy("p_brand"))).where("p_retailprice > m").select("p_partkey", "p_retailprice")


@query("SELECT c_mktsegment, c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, percent_rank() OVER w AS pr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
def ranks(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    q = Window.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_custkey")
    return table(s, d, "customer").select("c_mktsegment", "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.percent_rank().over(w).alias("pr"), F.ntile(4).over(q).alias("q"))


@query("SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS prev, lead(o_orderkey) OVER w AS next, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead_diff(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", F.lag(p, 1, 0.0).over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.round(p - F.lag(p).over(w), 4).alias("diff"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING), 3) AS run, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM (SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1)")
def running_total_and_share(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("c", F.count("*").over(Window.partitionBy("o_custkey", "o_orderdate"))).where("c = 1")
    w = Window.partitionBy("o_custkey")
    run = w.orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(run), 3).alias("run"), F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(w), 8).alias("share"))


@query("SELECT c_custkey, count(*) OVER (ORDER BY c_nationkey) AS peers, count(*) OVER (ORDER BY c_nationkey, c_custkey ROWS UNBOUNDED PRECEDING) AS n_rows FROM customer")
def range_frame_peers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    w = Window.partitionBy("c_nationkey")
    # running counts over all rows go through a small table of one row a nation, not through one task
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("k"))
    n = n.select("c_nationkey", F.sum("k").over(Window.orderBy("c_nationkey")).alias("peers"), "k")
    j = c.join(n, "c_nationkey")
    return j.select("c_custkey", "peers", (F.col("peers") - F.col("k") + F.row_number().over(w.orderBy("c_custkey"))).alias("n_rows"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS o, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 2) AS f FROM lineitem GROUP BY 1")
def pivot_sum(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return p.na.fill(0).select("l_returnflag", F.round("O", 2).alias("o"), F.round("F", 2).alias("f"))


@query("SELECT p_partkey, 'size' AS k, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "k", "v")


@query("SELECT c_mktsegment, c_nationkey, GROUPING_ID(c_mktsegment, c_nationkey) AS g, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, GROUPING_ID(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(s, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.06")
def except_all(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem")  # noqa: E741
    return l.where("l_quantity > 25").select(F.col("l_suppkey").alias("k")).exceptAll(l.where("l_discount > 0.06").select("l_suppkey"))


@query("SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part i WHERE i.p_type = p.p_type)")
def correlated_scalar(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    m = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("m"))
    return p.join(m, "p_type").where("p_retailprice > m").select("p_partkey", "p_retailprice")


@query("SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey = 1 THEN NULL ELSE s_nationkey END FROM supplier)")
def not_in_with_null(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "nation").createOrReplaceTempView("t_nation")
    table(s, d, "supplier").createOrReplaceTempView("t_supplier")
    return s.sql("SELECT count(*) AS n FROM t_nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey = 1 THEN NULL ELSE s_nationkey END FROM t_supplier)")


@query("""WITH RECURSIVE t AS (SELECT 1 AS lvl, r_regionkey AS id, CAST(r_name AS VARCHAR) AS path FROM region
UNION ALL SELECT lvl + 1, n_nationkey, path || '/' || n_name FROM t JOIN nation ON n_regionkey = id WHERE lvl = 1) SELECT lvl, path FROM t""")
def recursive_tree(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "nation").createOrReplaceTempView("t_nation")
    table(s, d, "region").createOrReplaceTempView("t_region")
    return s.sql("""WITH RECURSIVE t(lvl, id, path) AS (SELECT 1, r_regionkey, r_name FROM t_region
        UNION ALL SELECT lvl + 1, n_nationkey, concat(path, '/', n_name) FROM t JOIN t_nation ON n_regionkey = id WHERE lvl = 1) SELECT lvl, path FROM t""")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.75), 4) AS q75, round(median(p_retailprice), 4) AS med FROM part GROUP BY 1")
def quantiles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.75), 4).alias("q75"), F.round(F.median("p_retailprice"), 4).alias("med"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey FROM orders, q WHERE o_totalprice NOT BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)""")
def iqr_outliers(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    a, b = exact_quantiles(o, F.col("o_totalprice"), [0.25, 0.75])
    return o.where(~F.col("o_totalprice").between(a - 0.2 * (b - a), b + 0.2 * (b - a))).select("o_orderkey")


@query("""WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1)
SELECT o_orderpriority, count(*) AS n FROM orders JOIN g USING (o_orderpriority) WHERE abs(o_totalprice - m) / sd > 1.5 GROUP BY 1""")
def group_z_scores(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderpriority", "o_totalprice")
    g = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"))
    return o.join(g, "o_orderpriority").where("abs(o_totalprice - m) / sd > 1.5").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(corr(l_extendedprice, l_quantity), 6) AS r, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem")
def regression(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 5).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
ra AS (SELECT a, sum(o) AS t FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS u FROM c GROUP BY 1)
SELECT round(sum((coalesce(o, 0) - t * u / n) ** 2 / (t * u / n)), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN c USING (a, b)""")
def chi_square(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("o"))
    a, b, n = c.groupBy("a").agg(F.sum("o").alias("t")), c.groupBy("b").agg(F.sum("o").alias("u")), c.agg(F.sum("o").alias("n"))
    e = F.col("t") * F.col("u") / F.col("n")
    cells = a.crossJoin(b).crossJoin(n).join(c, ["a", "b"], "left")  # a cell of the cross table a row
    return cells.agg(F.round(F.sum((F.coalesce("o", F.lit(0)) - e) ** 2 / e), 4).alias("chi2"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"))


@query("""WITH g AS (SELECT c_mktsegment IN ('BUILDING') AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
SELECT round((max(CASE WHEN k THEN m END) - max(CASE WHEN NOT k THEN m END)) / sqrt(sum(v / n)), 6) AS t FROM g""")
def t_statistic(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    g = c.groupBy((F.col("c_mktsegment") == "BUILDING").alias("k")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"))
    return g.agg(F.round((F.max(F.when(F.col("k"), F.col("m"))) - F.max(F.when(~F.col("k"), F.col("m")))) / F.sqrt(F.sum(F.col("v") / F.col("n"))), 6).alias("t"))


@query("SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, month LIMIT 1")
def monthly_best(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "month").limit(1).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def latest_attempt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def distinct_keep_last(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return g.select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"))


@query("SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1")
def mode_value(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(1).select("p_brand")


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT w, count(*) AS n FROM w GROUP BY 1""")
def explode_word_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("SELECT p_size, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS bin, count(*) AS n FROM part GROUP BY 1, 2")
def cut_bins(s: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large")
    return table(s, d, "part").groupBy("p_size", b.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join_revenue(s: SparkSession, d: str) -> DataFrame:
    rev = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(rev, F.col("o_orderkey") == F.col("l_orderkey"))
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    g = o.groupBy("o_custkey").agg(F.sum("x").alias("x")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("x").alias("x"))
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return g.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", F.round("x", 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").where("l_shipdate <= TIMESTAMP'1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT event_id, last_signup FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events) WHERE event_type = 'purchase'""")
def as_of_join(s: SparkSession, d: str) -> DataFrame:
    """The last sign-up at or before each purchase: one sorted pass over each user's union of both sides."""
    e = table(s, d, "events").where(F.col("event_type").isin("purchase", "signup")).select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_signup", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w)).where("event_type = 'purchase'").select("event_id", "last_signup")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 45 THEN NULL ELSE p_size END, med) AS size FROM part, (SELECT median(CASE WHEN p_size > 45 THEN NULL ELSE p_size END) AS med FROM part)")
def median_imputation(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_size").cast("double")).alias("x"))
    return p.select("p_partkey", F.coalesce("x", F.lit(exact_quantiles(p, F.col("x"), [0.5])[0])).alias("size"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(h) AS a, max(h) AS z FROM h GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM b),
j AS (SELECT g.user_id, g.h, v, last_value(v IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN v IS NOT NULL THEN g.h END IGNORE NULLS) OVER w AS ph,
first_value(v IGNORE NULLS) OVER x AS nv, first_value(CASE WHEN v IS NOT NULL THEN g.h END IGNORE NULLS) OVER x AS nh FROM g LEFT JOIN h USING (user_id, h)
WINDOW w AS (PARTITION BY g.user_id ORDER BY g.h ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY g.user_id ORDER BY g.h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, count(*) AS n, round(avg(CASE WHEN nh = ph THEN pv ELSE pv + (nv - pv) * (epoch(h) - epoch(ph)) / (epoch(nh) - epoch(ph)) END), 5) AS mean FROM j GROUP BY 1""")
def interpolate_hours(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    g = h.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).select("user_id", F.explode(F.expr("sequence(a, z, INTERVAL 1 HOUR)")).alias("h"))
    j = g.join(h, ["user_id", "h"], "left")
    w = Window.partitionBy("user_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    x = Window.partitionBy("user_id").orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)  # a running frame from the end
    at = F.when(F.col("v").isNotNull(), F.unix_timestamp("h"))
    j = j.select("user_id", F.unix_timestamp("h").alias("t"), F.last("v", True).over(w).alias("pv"), F.last(at, True).over(w).alias("ph"), F.last("v", True).over(x).alias("nv"), F.last(at, True).over(x).alias("nh"))
    y = F.when(F.col("nh") == F.col("ph"), F.col("pv")).otherwise(F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("t") - F.col("ph")) / (F.col("nh") - F.col("ph")))
    return j.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(y), 5).alias("mean"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey AS k, -1.0 AS v FROM customer WHERE c_nationkey < 12) b ON a.k = b.k")
def combine_first(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    b = c.where("c_nationkey < 12").select(F.col("c_custkey").alias("k"), F.lit(-1.0).alias("w"))
    return a.join(b, "k", "full").select("k", F.coalesce("v", "w").alias("v"))


@query("""SELECT o_orderkey, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS q, CAST(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INTEGER) AS level,
CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders""")
def extract_and_label(s: SparkSession, d: str) -> DataFrame:
    label = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return table(s, d, "orders").select("o_orderkey", F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("q"), F.regexp_extract("o_orderpriority", "^([0-9])", 1).try_cast("int").alias("level"), F.coalesce(F.try_element_at(label, F.col("o_orderstatus")), F.lit("other")).alias("label"))


@query("""WITH m AS (SELECT doc_id, quality AS y, CAST(length(text) >= 500 AS INTEGER) AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM m) SELECT round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""")
def f1_from_counts(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "documents").select("doc_id", (F.length("text") >= 500).cast("int").alias("p")).join(table(s, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    c = m.agg(F.sum(F.expr("y * p")).alias("tp"), F.sum(F.expr("(1 - y) * p")).alias("fp"), F.sum(F.expr("y * (1 - p)")).alias("fn"))
    return c.select(F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 8).alias("f1"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_field(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).where("k >= 50")


@query("""SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS most FROM lineitem""")
def described(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem")  # noqa: E741
    c = F.col("l_quantity")
    q = exact_quantiles(l, c, [0.25, 0.5, 0.75])
    return l.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("least"), *(F.lit(float(x)).alias(f"q{i}") for i, x in enumerate(q, 1)), F.max(c).alias("most"))


@query("""SELECT user_id, event_id, CASE WHEN p <> 0 THEN round(value / p - 1, 6) END AS change FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def pct_change(s: SparkSession, d: str) -> DataFrame:
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").withColumn("p", p).select("user_id", "event_id", F.when(F.col("p") != 0, F.round(F.col("value") / F.col("p") - 1, 6)).alias("change"))


@query("""SELECT c_custkey, s_name, o_n, p_name FROM (SELECT c_custkey, s_name, o.n AS o_n, p_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey AND p_size > 25 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
WHERE CAST(s_name IS NOT NULL AS INTEGER) + CAST(o_n IS NOT NULL AS INTEGER) + CAST(p_name IS NOT NULL AS INTEGER) >= 2""")
def dropped_by_threshold(s: SparkSession, d: str) -> DataFrame:
    """Rows with at least two of three values."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o_n"))
    x = table(s, d, "customer").select("c_custkey").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left")
    x = x.join(table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("c_custkey"), "p_name"), "c_custkey", "left").join(o, "c_custkey", "left")
    return x.na.drop(thresh=2, subset=["s_name", "o_n", "p_name"]).select("c_custkey", "s_name", "o_n", "p_name")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, CAST(o_totalprice > a AS INTEGER) + CAST(o_totalprice > b AS INTEGER) + CAST(o_totalprice > c AS INTEGER) AS quarter FROM orders, q""")
def quantile_cut(s: SparkSession, d: str) -> DataFrame:
    """Orders by quarters of their price; a bin holds its upper edge."""
    o = table(s, d, "orders")
    edges = exact_quantiles(o, F.col("o_totalprice"), [0.25, 0.5, 0.75])
    return o.select("o_orderkey", sum((F.when(F.col("o_totalprice") > float(x), 1).otherwise(0) for x in edges), F.lit(0)).alias("quarter"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY x DESC NULLS LAST, p_partkey) AS last, row_number() OVER (ORDER BY x NULLS FIRST, p_partkey) AS first FROM (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_size END AS x FROM part)""")
def null_placement(s: SparkSession, d: str) -> DataFrame:
    """Places with nulls last and first: rows before a value's are counted by value, then numbered inside it."""
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 > 0, F.col("p_size")).alias("x"))
    n = p.groupBy("x").agg(F.count("*").alias("n"))  # a row a value
    out = p
    for name, order in (("last", F.desc_nulls_last("x")), ("first", F.asc_nulls_first("x"))):
        before = F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        head = n.select(F.col("x").alias("_x"), before.alias(f"_{name}"))
        out = out.join(F.broadcast(head), F.col("x").eqNullSafe(F.col("_x"))).drop("_x")
    inner = F.row_number().over(Window.partitionBy("x").orderBy("p_partkey"))
    return out.select("p_partkey", (F.col("_last") + inner).alias("last"), (F.col("_first") + inner).alias("first"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 35""")
def page_of_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(35).limit(20)
