"""Plans over tests and fitted models; data on which the answer is known without a model."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.plans.catalog import query
from tessera.session import table


@query("SELECT count(*) FILTER (o_orderstatus = 'P') + count(*) FILTER (o_totalprice > 250000) AS cells FROM orders")
def null_cells(s: SparkSession, d: str) -> DataFrame:
    """Empty cells of a whole table: nulls, and NaN among numbers."""
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 250000, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"))
    empty = [F.col(c).isNull() | (F.isnan(c) if t == "double" else F.lit(False)) for c, t in o.dtypes]
    return o.agg(reduce(lambda a, b: a + b, [F.count_if(e) for e in empty]).alias("cells"))


_T_CDF = """c AS (SELECT exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS k, df, t FROM s), i AS (SELECT t, df, sum(CASE WHEN g IN (0, 4000) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * k * (1 + (abs(t) * g / 4000) ** 2 / df) ** (-(df + 1) / 2.0)) * abs(t) / 4000 / 3 AS half FROM c, generate_series(0, 4000) u(g) GROUP BY t, df)"""


@query(f"""WITH s AS (SELECT (avg(c_acctbal) - 4300) / (stddev_samp(c_acctbal) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM customer), {_T_CDF} SELECT round(t, 4) AS t, round(1 - 2 * half, 4) AS p FROM i""")
def one_mean(s: SparkSession, d: str) -> DataFrame:
    t, p, _ = stats.mean_test(table(s, d, "customer"), F.col("c_acctbal"), 4300.0)
    return s.createDataFrame([(round(t, 4), round(p, 4))], "t double, p double")


@query(f"""WITH m AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) / sqrt(count(*)) AS e, CAST(count(*) - 1 AS DOUBLE) AS df FROM supplier), g AS (SELECT i / 1000.0 AS t, df FROM m, generate_series(1900, 3200) u(i)),
c AS (SELECT t, df, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS k FROM g), h AS (SELECT t, sum(CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * k * (1 + (t * j / 400) ** 2 / df) ** (-(df + 1) / 2.0)) * t / 400 / 3 AS half FROM c, generate_series(0, 400) u(j) GROUP BY t)
SELECT round((SELECT min(t) FROM h WHERE half >= 0.475), 2) AS quantile, round(m, 4) AS mean FROM m""")
def mean_interval(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "supplier")
    m, e = x.agg(F.avg("s_acctbal"), F.stddev_samp("s_acctbal") / F.sqrt(F.count("*"))).first()
    half = (stats.mean_test(x, F.col("s_acctbal"), 0.0)[2] - m) / e  # of the interval, in standard errors
    return s.createDataFrame([(round(int(half * 1000 + 1) / 1000, 2), round(m, 4))], "quantile double, mean double")


@query(f"""WITH g AS (SELECT c_mktsegment = 'BUILDING' AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), a AS (SELECT * FROM g WHERE NOT k), b AS (SELECT * FROM g WHERE k),
s AS (SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, CAST(a.n + b.n - 2 AS DOUBLE) AS df FROM a, b), {_T_CDF} SELECT round(t, 4) AS t, round(1 - 2 * half, 4) AS p FROM i""")
def two_means(s: SparkSession, d: str) -> DataFrame:
    t, p = stats.two_means(table(s, d, "customer"), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    return s.createDataFrame([(round(t, 4), round(p, 4))], "t double, p double")


@query("""WITH m AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS c FROM customer GROUP BY 1), z AS (SELECT g, abs(c_acctbal - c) AS z FROM customer JOIN m ON g = c_mktsegment), a AS (SELECT g, count(*) AS n, avg(z) AS m, sum(z) AS t, var_pop(z) AS v FROM z GROUP BY 1), x AS (SELECT sum(t) / sum(n) AS x FROM a),
k AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)
SELECT round((sum(n) - count(*)) / (count(*) - 1) * sum(n * (m - x) ** 2) / sum(n * v), 5) AS w, (SELECT round(count(*) / 6.0 * (avg(((c_acctbal - m) / s) ** 3) ** 2 + (avg(((c_acctbal - m) / s) ** 4) - 3) ** 2 / 4), 3) FROM customer, k) AS jb FROM a, x""")
def spreads(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    w = stats.spread_test(c, "c_mktsegment", "c_acctbal", c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("center")))
    return w.crossJoin(stats.normality(c, "c_acctbal")).select(F.round("w", 5).alias("w"), F.round("jb", 3).alias("jb"))  # one row each


@query("""WITH t AS (SELECT c_custkey AS id, c_acctbal AS x, c_acctbal > 5000 AS label FROM customer), d AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x), b.id) AS r FROM t a JOIN t b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT id, sum(CASE WHEN label THEN 1 ELSE 0 END) >= 2 AS label FROM d WHERE r <= 3 GROUP BY 1""")
def nearest_labels(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("x"), (F.col("c_acctbal") > 5000).alias("label"))
    return stats.nearest(t, t.where("id % 20 = 0"), 3)


_DEAR = "SELECT l_orderkey % 3 AS fold, l_quantity AS q, l_discount AS d, l_tax AS t, CAST(floor(l_quantity / 10) AS INTEGER) AS kind, CAST(l_quantity * l_extendedprice > 1300000 AS INTEGER) AS y FROM lineitem"


def _dear(s: SparkSession, d: str) -> DataFrame:
    """Items with a fold, three numbers, a kind (tens of their quantity), and whether they are dear."""
    x = table(s, d, "lineitem")
    return x.select((F.col("l_orderkey") % 3).cast("int").alias("fold"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"), F.floor(F.col("l_quantity") / 10).cast("string").alias("kind"), (F.col("l_quantity") * F.col("l_extendedprice") > 1300000).cast("double").alias("label"))


@query(f"""WITH x AS ({_DEAR}), n AS (SELECT fold, kind, count(*) AS n, sum(y) AS y FROM x GROUP BY 1, 2), t AS (SELECT a.fold, a.kind, a.n, a.y, sum(b.y) * 2 > sum(b.n) AS says FROM n a JOIN n b ON a.kind = b.kind AND a.fold <> b.fold GROUP BY 1, 2, 3, 4),
f AS (SELECT fold, sum(CASE WHEN says THEN y ELSE n - y END) / sum(n) AS accuracy FROM t GROUP BY 1) SELECT round(avg(accuracy), 6) AS accuracy FROM f""")
def validated_model(s: SparkSession, d: str) -> DataFrame:
    """Cross-validation, by given folds, of a logistic regression on 0/1 columns of one kind each: without a penalty it says of a
    kind what most of its rows in the other folds say."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(maxIter=200, tol=1e-9, regParam=0.0)
    p = Pipeline(stages=[StringIndexer(inputCol="kind", outputCol="i", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="i", outputCol="features"), lr])
    cv = CrossValidator(estimator=p, estimatorParamMaps=ParamGridBuilder().addGrid(lr.fitIntercept, [True]).build(), evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=3, foldCol="fold").fit(_dear(s, d))
    return s.createDataFrame([(round(float(cv.avgMetrics[0]), 6),)], "accuracy double")


@query(f"""WITH x AS ({_DEAR}), f AS (SELECT arg_max(n, abs(r)) AS feature FROM (SELECT 'q' AS n, corr(q, y) AS r FROM x UNION ALL SELECT 'd', corr(d, y) FROM x UNION ALL SELECT 't', corr(t, y) FROM x)),
v AS (SELECT CASE feature WHEN 'q' THEN q WHEN 'd' THEN d ELSE t END AS v, y FROM x, f), g AS (SELECT v, sum(y) AS pos, count(*) - sum(y) AS neg FROM v GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT (SELECT feature FROM f) AS feature, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) AS auc FROM c""")
def eliminated_features(s: SparkSession, d: str) -> DataFrame:
    """The feature that is left of three, and the area under its curve: the share of pairs it puts in order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = _dear(s, d)
    left = stats.eliminate(x, ["d", "q", "t"], "label", 1)
    v = VectorAssembler(inputCols=left, outputCol="features").transform(x)
    auc = BinaryClassificationEvaluator(numBins=0).evaluate(LogisticRegression(regParam=0.01).fit(v).transform(v))
    return s.createDataFrame([(left[0], round(auc, 4))], "feature string, auc double")


@query(f"""WITH x AS ({_DEAR}), g AS (SELECT q, count(*) AS n, sum(y) AS y FROM x GROUP BY 1), a AS (SELECT sum(n) AS n, sum(y) AS y FROM g),
c AS (SELECT q, (q + lead(q) OVER (ORDER BY q)) / 2 AS bound, sum(g.n) OVER (ORDER BY q) AS n1, sum(g.y) OVER (ORDER BY q) AS y1, a.n, a.y FROM g, a),
i AS (SELECT bound, (y1 * 2 > n1) <> ((y - y1) * 2 > n - n1) AS parts, greatest(y1, n1 - y1) + greatest(y - y1, n - n1 - y + y1) AS good, n, n1 * 2.0 * (y1 / n1) * (1 - y1 / n1) + (n - n1) * 2.0 * ((y - y1) / (n - n1)) * (1 - (y - y1) / (n - n1)) AS gini FROM c WHERE bound IS NOT NULL)
SELECT CASE WHEN arg_min(parts, gini) THEN arg_min(bound, gini) END AS bound, round(arg_min(good, gini) / any_value(n), 6) AS accuracy FROM i""")
def searched_depth(s: SparkSession, d: str) -> DataFrame:
    """A tree of the least depth on one column: where it parts it (nowhere, if both parts say the same), and how often it is
    right."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["q"], outputCol="features").transform(_dear(s, d))
    m = DecisionTreeClassifier(maxDepth=1, maxBins=64, seed=1).fit(v)
    right = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(m.transform(v))
    parted = re.search(r"feature 0 <= ([0-9.]+)", m.toDebugString)
    bound = float(parted[1]) if parted else None
    return s.createDataFrame([(bound, round(right, 6))], "bound double, accuracy double")


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT round((1 + abs(r)) / 2, 5) AS share, 1.0::DOUBLE AS silhouette FROM r""")
def component_share(s: SparkSession, d: str) -> DataFrame:
    """The share of two standardized columns' spread on their first component, and the silhouette of two clusters of equal rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    x = table(s, d, "lineitem").select("l_quantity", "l_extendedprice")
    m = Pipeline(stages=[VectorAssembler(inputCols=x.columns, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True), PCA(k=2, inputCol="z", outputCol="p")]).fit(x)
    two = VectorAssembler(inputCols=["f"], outputCol="features").transform(table(s, d, "supplier").select((F.col("s_suppkey") % 2 * 100).cast("double").alias("f")))
    sil = ClusteringEvaluator().evaluate(KMeans(k=2, seed=1).fit(two).transform(two))
    return s.createDataFrame([(round(float(m.stages[-1].explainedVariance[0]), 5), round(sil, 4))], "share double, silhouette double")


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS seoul, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d') AS day FROM events""")
def time_zones(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.date_format(F.from_utc_timestamp("ts", "Asia/Seoul"), "yyyy-MM-dd HH:mm").alias("seoul"), F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd").alias("day"))
