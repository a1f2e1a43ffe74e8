"""Every registered query of the general engine: a Spark plan and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import FOLD
from tessera.session import table

_FROM, _TO = (x.replace("'", "''") for x in FOLD)
#: The search fold of a column ``text`` in SQL.
FOLD_SQL = f"translate(text, '{_FROM}', '{_TO}')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM events GROUP BY 1),
z AS (SELECT days.day, coalesce(c, 0) AS n_events FROM days LEFT JOIN n USING (day))
SELECT CAST(day AS VARCHAR) AS day, n_events, CASE WHEN max(n_events) OVER () = 0 THEN 0.0 ELSE round(n_events * 100.0 / max(n_events) OVER (), 6) END AS height FROM z
""")
def usage_month_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-31')) AS day")
    n = table(spark, sf_dir, "events").where("ts >= '2024-01-01' AND ts < '2024-02-01'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    z = days.join(n, "day", "left").select("day", F.coalesce("c", F.lit(0)).alias("n_events"))
    top = F.max("n_events").over(Window.partitionBy())
    return z.select(F.col("day").cast("string").alias("day"), "n_events", F.when(top == 0, 0.0).otherwise(F.round(F.col("n_events") * 100.0 / top, 6)).alias("height"))


from tessera.plans import relational as _relational  # noqa: E402,F401  (registers its queries)
from tessera.plans import schedules as _schedules, textual as _textual  # noqa: E402,F401
from tessera.plans import retrieval as _retrieval  # noqa: E402,F401
from tessera.plans import flows as _flows  # noqa: E402,F401
from tessera.plans import studies as _studies  # noqa: E402,F401
from tessera.plans import quotes as _quotes  # noqa: E402,F401
from tessera.plans import trainer as _trainer  # noqa: E402,F401
from tessera.plans import library as _library  # noqa: E402,F401
from tessera.plans import quizzes as _quizzes  # noqa: E402,F401
from tessera.plans import outlines as _outlines  # noqa: E402,F401
from tessera.plans import content as _content  # noqa: E402,F401
from tessera.plans import pages as _pages  # noqa: E402,F401
from tessera.plans import models as _models  # noqa: E402,F401
from tessera.plans import more as _more  # noqa: E402,F401
from tessera.plans import shapes as _shapes  # noqa: E402,F401
from tessera.plans import streams as _streams  # noqa: E402,F401
