"""Plans that play a table as a stream, each equal to SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import postings
from tessera.plans.catalog import FOLD_SQL, query
from tessera.session import new_folder, table
from tessera.streaming import ingest, reading, replay, usage


@query("""WITH o AS (SELECT user_id, ts, event_type, CAST(floor(value * 100) AS BIGINT) AS amount, lag(ts) OVER w AS p, lag(event_type) OVER w AS line FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, p AS a, least(ts, p + INTERVAL 120 SECOND) AS b FROM o WHERE p IS NOT NULL),
t AS (SELECT user_id, CAST(a AS DATE) AS day, epoch_us(least(b, date_trunc('day', a) + INTERVAL 1 DAY)) - epoch_us(a) AS us, 0 AS lines, 0 AS amount, NULL AS page FROM g
UNION ALL SELECT user_id, CAST(b AS DATE), epoch_us(b) - epoch_us(date_trunc('day', b)), 0, 0, NULL FROM g WHERE CAST(b AS DATE) > CAST(a AS DATE)
UNION ALL SELECT user_id, CAST(ts AS DATE), 0, CAST(line IS DISTINCT FROM event_type AS INTEGER), CASE WHEN line IS DISTINCT FROM event_type THEN amount ELSE 0 END, event_type FROM o)
SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(sum(us) AS BIGINT) AS us, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(amount) AS BIGINT) AS amount, count(DISTINCT page) AS pages FROM t GROUP BY 1, 2 HAVING sum(us) > 0 OR count(page) > 0""")
def reading_log_stream(s: SparkSession, d: str) -> DataFrame:
    """The reading log over events that come up to two days out of order, in micro-batches: time, lines that differ from the
    one before with their amounts, pages once a day."""
    e = table(s, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.col("event_type").alias("line"), F.floor(F.col("value") * 100).alias("amount"))
    first, last = e.agg(F.min("ts"), F.max("ts")).select(F.unix_micros("min(ts)"), F.unix_micros("max(ts)")).first()
    late = 2 * reading.DAY_US
    came = (F.unix_micros("ts") - F.lit(first) + F.pmod(F.xxhash64("id"), F.lit(late))) / F.lit(float(max(1, last - first + late)))
    end = {"user_id": F.lit(-1), "ts": F.timestamp_micros(F.lit(last + 30 * reading.DAY_US))}
    folder, out = replay.slices(e, came, 8, end), new_folder(s, "reading-log")
    with reading.state_store(s):
        replay.play(folder, e.schema, reading.log, usage.additive_sink(out))
    steps = s.read.schema("user_id long, day date, us long, lines long, amount long, pages long").parquet(out)
    return reading.totals(steps).withColumn("day", F.col("day").cast("string")).drop("batch")


_DOC = "doc_id long, text string, seq long"
_GRAM = "gram long, doc_id long"


def _ingested(s: SparkSession, d: str) -> ingest.Ingest:
    """Documents that come in five batches, a third of them twice with another text first, each batch written twice; the
    rules change on the way."""
    docs = table(s, d, "documents").select("doc_id", "text", F.lit(1).cast("long").alias("seq"))
    drafts = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("draft license "), F.substring("text", 1, 500)).alias("text"), F.lit(0).cast("long").alias("seq"))
    rows = docs.unionByName(drafts)
    first = F.pmod(F.xxhash64("doc_id"), F.lit(40)) / 100.0
    folder = replay.slices(rows, F.when(F.col("seq") == 0, first).when(F.col("doc_id") % 3 == 0, first + 0.25 + F.pmod(F.col("doc_id"), F.lit(5)) / 15.0).otherwise(first * 2.4), 5)
    out = new_folder(s, "ingest")
    old = ingest.Ingest(s, out, "doc_id", _DOC, lambda x: postings.postings(x.where("length(text) > 100")), _GRAM, "old", "seq")
    new = ingest.Ingest(s, out, "doc_id", _DOC, postings.postings, _GRAM, "new", "seq")

    def sink(batch: DataFrame, batch_id: int) -> None:
        rules = old if batch_id < 3 else new
        rules.sink(batch, batch_id)
        if batch_id % 2:
            rules.sink(batch, batch_id)  # as after a failure between the write and its commit

    replay.play(folder, rows.schema, lambda x: x, sink)
    new.recompute()
    return new


@query(f"""WITH f AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents)
SELECT doc_id, CAST(len(list_filter(generate_series(0, length(f) - 7), lambda i: f[i + 1:i + 7] = 'license' AND (i = 0 OR NOT regexp_matches(f[i:i], '[\\p{{L}}\\p{{N}}]')))) AS BIGINT) AS n FROM f WHERE regexp_matches(f, '(^|[^\\p{{L}}\\p{{N}}])license')""")
def ingested_search(s: SparkSession, d: str) -> DataFrame:
    """Hits in documents that were ingested in batches, by the postings that were derived on the way."""
    i = _ingested(s, d)
    rows = postings.stored(i.derived(), new_folder(s, "postings"), s.sparkContext.defaultParallelism, most=i.derived_at_most())
    return postings.counted(i.base(), rows, "license").select("doc_id", F.col("n").cast("long").alias("n"))


@query(f"""WITH g AS (SELECT doc_id, regexp_extract_all({FOLD_SQL}, '(?s).') AS c FROM documents), t AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM g),
n AS (SELECT gram, count(*) AS n FROM t GROUP BY 1) SELECT n, count(*) AS grams FROM n GROUP BY 1""")
def gram_histogram(s: SparkSession, d: str) -> DataFrame:
    """In how many documents grams are, and how many grams are in so many, out of ingested postings."""
    return postings.frequencies(_ingested(s, d).derived()).groupBy("n").agg(F.count("*").alias("grams"))
