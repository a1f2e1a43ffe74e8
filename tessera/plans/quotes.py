"""Plans over quotes, citations and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cite, parse
from tessera.operators import anchors
from tessera.plans.catalog import query
from tessera.session import stored, table


_CHANGED = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id, i, t, CASE i % 3 WHEN 1 THEN '* ' || t WHEN 2 THEN translate(t, 'abcdefghijklmnopqrstuvwxyz ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-') ELSE t END AS now FROM l),
n AS (SELECT doc_id, 'A new beginning.' || chr(10) || string_agg(now, chr(10) ORDER BY i) AS text FROM c GROUP BY 1)"""


@query(f"""WITH {_CHANGED}, q AS (SELECT doc_id, i, t, trim(substr(t, 1, 24), ' ') AS q FROM l WHERE length(t) >= 40 AND regexp_full_match(t, '[A-Za-z0-9 ,.]*'))
SELECT q.doc_id, q.i AS line, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.doc_id = q.doc_id AND trim(regexp_replace(c.now, '\\s+', ' ', 'g')) = trim(regexp_replace(q.t, '\\s+', ' ', 'g')) AND contains(c.now, q.q)) THEN 'para'
WHEN contains(n.text, q.q) THEN 'page' ELSE 'fuzzy' END AS how, CASE WHEN length(n.text) - length(replace(n.text, q.q, '')) = length(q.q) THEN strpos(n.text, q.q) - 1 END AS once FROM q JOIN n ON n.doc_id = q.doc_id""")
def anchors_resolve(s: SparkSession, d: str) -> DataFrame:
    """The beginning of each longer plain line as an anchor, found again in texts that have a new first line, and of whose
    lines a third were moved in and a third are written in capitals with hyphens: how each was found, and where those that
    stand at one place only."""
    docs = table(s, d, "documents").select("doc_id", "text")
    old = anchors.paragraphs(docs)
    plain = old.where((F.length("text") >= 40) & F.col("text").rlike(r"\A[A-Za-z0-9 ,.]*\z"))
    a = plain.select("doc_id", F.col("para").alias("line"), "hash", anchors.anchor(F.col("text"), F.lit(0), F.lit(24)).alias("a"), "base").select("doc_id", "line", "hash", "a.exact", "a.prefix", "a.suffix", (F.col("base") + F.col("a.at")).alias("at"))
    lower = "abcdefghijklmnopqrstuvwxyz "
    now = lambda t, i: F.when(i % 3 == 1, F.concat(F.lit("* "), t)).when(i % 3 == 2, F.translate(t, lower, lower.upper().replace(" ", "-"))).otherwise(t)
    new = stored(docs.select("doc_id", F.concat(F.lit("A new beginning.\n"), F.array_join(F.transform(F.split("text", "\n"), now), "\n")).alias("text")))
    r = anchors.resolve(a, new).join(new, "doc_id")
    r = r.withColumn("first", F.when(F.col("found.how").isin("para", "page"), F.position("exact", "text")))
    once = (F.col("first") > 0) & (F.position("exact", "text", F.col("first") + F.length("exact")) == 0)
    return r.select("doc_id", F.col("line").cast("long").alias("line"), "found.how", F.when(once, F.col("found.at")).cast("long").alias("once"))


#: Paragraphs of seven sentences each, by customer: (text, is it a reference, its kind).
_CITED = (
    ("It is so, says c_name.", False, None),
    ("Jones CD, Van Berg A. On the segment of c_name.", True, None),
    ("More of the title.", True, None),
    ("2022;c_nationkey(3):381-9.", True, None),
    ("Smith-Roe AB, et al. J Endocr Soc. 2024.", True, "etal"),
    ("2023 Mar 4; 17:e101-9.", True, None),
    ("PMID 1234567c_nationkey.", True, "id"),
)
_CITED_SQL = " UNION ALL ".join(f"SELECT c_custkey AS doc, {i} AS seq, {k!r} AS kind FROM customer".replace("None", "NULL") for i, (_, ref, k) in enumerate(_CITED) if ref)


@query(_CITED_SQL)
def citation_marks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    text = lambda t: F.replace(F.replace(F.lit(t), F.lit("c_name"), F.col("c_name")), F.lit("c_nationkey"), F.col("c_nationkey").cast("string"))
    x = c.select(F.col("c_custkey").alias("doc"), F.posexplode(F.array(*[text(t) for t, _, _ in _CITED])).alias("seq", "text"))
    return cite.mark_references(x).where("reference").select("doc", "seq", "kind")


@query("""WITH c AS (SELECT CAST(count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 150000) AS DOUBLE) AS a, count(*) FILTER (o_orderstatus = 'O' AND NOT o_totalprice > 150000) AS b,
count(*) FILTER (o_orderstatus <> 'O' AND o_totalprice > 150000) AS c, count(*) FILTER (o_orderstatus <> 'O' AND NOT o_totalprice > 150000) AS d FROM orders) SELECT 'dear' AS name, round(a * d / (b * c), 4) AS odds FROM c""")
def logistic_odds(s: SparkSession, d: str) -> DataFrame:
    """The odds ratio of dear orders to be open, by a logistic regression without a penalty on one yes-or-no column: that is
    the cross ratio of four counts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = table(s, d, "orders").select((F.col("o_orderstatus") == "O").cast("double").alias("label"), (F.col("o_totalprice") > 150000).cast("double").alias("dear"))
    m = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-12, standardization=False).fit(VectorAssembler(inputCols=["dear"], outputCol="features").transform(x))
    return s.createDataFrame([("dear", float(m.coefficients[0]))], "name string, coefficient double").select("name", F.round(F.exp("coefficient"), 4).alias("odds"))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT round(sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)), 3) AS rmse FROM lineitem, m""")
def linear_rmse(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(table(s, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")))
    m = LinearRegression(solver="normal", regParam=0.0).fit(x)
    e = F.col("label") - F.lit(m.intercept) - F.lit(float(m.coefficients[0])) * F.col("l_quantity")
    return x.agg(F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


@query("SELECT count(*) AS n, CAST(min(c_nationkey) AS INTEGER) AS least, CAST(max(c_nationkey) AS INTEGER) AS most FROM customer GROUP BY c_nationkey // 5")
def embedding_clusters(s: SparkSession, d: str) -> DataFrame:
    """k-means on a line where five groups of nations stand far apart: the clusters are these groups."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    c = table(s, d, "customer").select("c_nationkey", (F.floor(F.col("c_nationkey") / 5) * 1000 + F.col("c_nationkey") % 5).cast("double").alias("x"))
    x = VectorAssembler(inputCols=["x"], outputCol="features").transform(c)
    m = KMeans(k=5, seed=1, maxIter=20, initSteps=5).fit(x)
    return m.transform(x).groupBy("prediction").agg(F.count("*").alias("n"), F.min("c_nationkey").alias("least"), F.max("c_nationkey").alias("most")).drop("prediction")
