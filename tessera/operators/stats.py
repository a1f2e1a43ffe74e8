"""Tests of means and spreads, neighbours, and small model searches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stored

#: Rows of either side that a task of nearest() holds, and into how many ranges rows are sorted at most.
BLOCK, MOST_PARTS = 4096, 1000


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function, by the regularized incomplete beta function."""
    x = df / (df + t * t)
    half = _beta(df / 2, 0.5, x) / 2
    return 1 - half if t > 0 else half


def _beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction, on the side where it converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 10_000):
        step = 1.0
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            step *= c * d
            f *= c * d
        if abs(step - 1) < 1e-14:
            break
    return front * f


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def mean_test(df: DataFrame, value: Column, against: float) -> tuple[float, float, float]:
    """(t, p, upper end of the 95 % interval) of a column's mean against a number. Three sums leave the data."""
    n, m, s = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    e = s / math.sqrt(n)
    t = (m - against) / e
    return t, 2 * (1 - t_cdf(abs(t), n - 1)), m + t_quantile(0.975, n - 1) * e


def two_means(df: DataFrame, group: Column, value: Column) -> tuple[float, float]:
    """(t, p) of two groups' means, their spreads taken as one."""
    (_, n, a, v), (_, m, b, w) = sorted(tuple(r) for r in df.groupBy(group.alias("g")).agg(F.count(value), F.avg(value), F.var_samp(value)).collect())
    pooled = ((n - 1) * v + (m - 1) * w) / (n + m - 2)
    t = (a - b) / math.sqrt(pooled * (1 / n + 1 / m))
    return t, 2 * (1 - t_cdf(abs(t), n + m - 2))


def spread_test(df: DataFrame, group: str, value: str, centers: DataFrame) -> DataFrame:
    """Levene's statistic (w): do groups spread alike? centers: group, center (median or mean)."""
    z = df.join(centers, group).select(group, F.abs(F.col(value) - F.col("center")).alias("z"))
    g = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    g = g.withColumn("all", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()))
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)), F.sum(F.col("n") * F.col("v"))
    return g.agg(((F.sum("n") - F.count("*")) / (F.count("*") - 1) * between / within).alias("w"))


def normality(df: DataFrame, value: str) -> DataFrame:
    """Jarque and Bera's statistic of a column: zero for a normal one's skewness and kurtosis."""
    return df.agg((F.count(value) / 6.0 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)).alias("jb"))


def nearest(train: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """id, label: by the majority of the k nearest rows of train (id, x array, label) for a stated set of rows (id, x); ties go
    to the nearer, then to the smaller id.

    Of rows with the same x only the first k + 1 can be among the nearest. The rest is cut along the first number of x into
    blocks of some BLOCK rows. Each asked row looks into the block at its place; what it finds there bounds its distance, and
    of the others it looks only into those whose stretch begins within that distance. A task holds BLOCK rows of each side.
    """
    t, q = dict(train.dtypes), dict(asked.dtypes)
    same = Window.partitionBy("x").orderBy("id")
    kept = train.where("id IS NOT NULL AND x IS NOT NULL").select("id", "x", "label").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    kept = stored(kept.withColumn("_x", F.get("x", F.lit(0)).cast("double")).where("NOT isnan(_x)"))
    parts = max(1, min(MOST_PARTS, -(-kept.count() // BLOCK)))
    kept = kept.repartitionByRange(parts, "_x", "id").withColumn("_part", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("_part").orderBy("_x", "id")) - 1
    rows = stored(kept.withColumn("block", F.col("_part").cast("long") * (1 << 32) + F.floor(n / BLOCK)))
    blocks = rows.groupBy("block").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    points = stored(asked.select(F.col("id").alias("q"), F.col("x").alias("p"), F.get("x", F.lit(0)).cast("double").alias("_at")))
    gap = F.greatest(F.col("lo") - F.col("_at"), F.col("_at") - F.col("hi"), F.lit(0.0))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["q", "d", "id", "label"])
        left = left.sort_values("id")
        x, p = np.array(left["x"].tolist(), float), np.array(right["p"].tolist(), float)
        ids = left["id"].to_numpy()
        best = []
        for q, own in zip(right["q"], p):
            d = np.sqrt(((x - own) ** 2).sum(1))
            d[ids == q] = np.inf  # a row is no neighbour of its own
            at = np.argsort(d, kind="stable")[:k]
            best += [(q, d[i], i) for i in at if np.isfinite(d[i])]
        at = [i for _, _, i in best]
        return pd.DataFrame({"q": [q for q, _, _ in best], "d": [d for _, d, _ in best], "id": ids[at], "label": [left["label"].iloc[i] for i in at]})

    def look(pairs: DataFrame) -> DataFrame:
        """The k best of each pair of an asked row and a block; rows of a block are sent once for each BLOCK rows that ask."""
        many = pairs.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_m"))
        left = rows.select("id", "x", "label", "block").join(many, "block").select("id", "x", "label", "block", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("squad"))
        right = pairs.select("q", "p", "block").join(many.withColumnRenamed("_m", "_of"), "block").select("q", "p", F.col("block").alias("own"), F.pmod(F.xxhash64("q"), F.col("_of")).cast("int").alias("turn"))
        return left.groupBy("block", "squad").cogroup(right.groupBy("own", "turn")).applyInPandas(run, f"q {q['id']}, d double, id {t['id']}, label {t['label']}")

    every = points.join(F.broadcast(blocks))  # one row for BLOCK rows
    home = every.groupBy("q").agg(F.min_by("block", F.struct(gap, "block")).alias("block"))
    first = stored(look(points.join(home, "q")))
    far = first.groupBy("q").agg(F.when(F.count("*") >= k, F.max("d")).alias("_d"))
    reach = points.join(home.withColumnRenamed("block", "_home"), "q").join(far, "q", "left").join(F.broadcast(blocks))
    others = reach.where((F.col("block") != F.col("_home")) & (F.col("_d").isNull() | (gap <= F.col("_d") * (1 + 1e-9))))
    found = first.unionByName(look(stored(others.select("q", "p", "block"))))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
    votes = top.groupBy(F.col("q").alias("id"), "label").agg(F.count("*").alias("n"), F.min("r").alias("r"))
    return votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), "r")).alias("label"))


def eliminate(df: DataFrame, features: list[str], label: str, keep: int) -> list[str]:
    """Features that are left when a logistic regression on standardized ones drops the weakest, one at a time."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    left = list(features)
    while len(left) > keep:
        m = Pipeline(stages=[VectorAssembler(inputCols=left, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=0.01)]).fit(df)
        weight = [abs(float(c)) for c in m.stages[-1].coefficients]
        left.pop(int(np.argmin(weight)))
    return left
