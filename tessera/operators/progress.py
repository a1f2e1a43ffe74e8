"""A learner's progress: read from JSON, merged out of two copies, kept in logs, exams in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days that logs keep, days of a measured speed, seconds a review where none is known, calls for 10,000 characters where
#: none are measured, new cards a day and the most of them, days after which a backup is stale, exams that are kept.
LOG_DAYS, USAGE_DAYS, RECENT_DAYS, REVIEW_SECONDS, CALLS, NEW_CARDS, MOST_NEW, STALE_DAYS, EXAMS = 60, 90, 14, 8, 1.7, 20, 100, 30, 20
#: Ways of reading that are logged apart: the source, both, the translation.
BUCKETS = ("src", "both", "tr")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))


def loaded(raw: DataFrame, key: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(key, id, box, due, correct, wrong) of the readable records, and (key, value) of those that are not and are kept
    aside as they came. A record is readable if it is an object of version 1; an entry that is no object with a number
    for its box is left out, any other field of the wrong kind is empty."""
    p = F.try_parse_json(F.col(value))
    d = raw.select(key, value, p.alias("_p")).withColumn("_v", F.try_variant_get("_p", "$.version", "variant"))
    good = F.coalesce(is_number(F.col("_v")) & (F.try_variant_get("_v", "$", "double") == 1), F.lit(False))
    d = d.withColumn("_good", good)
    entries = d.where("_good").select(key, F.try_variant_get("_p", "$.quiz", "variant").alias("_q"))
    entries = entries.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("_q").outer())).select(key, F.col("key").alias("id"), F.col("value").alias("_e"))
    box, due = F.try_variant_get("_e", "$.box", "variant"), F.try_variant_get("_e", "$.due", "variant")
    whole = lambda n: F.when(is_number(F.try_variant_get("_e", f"$.{n}", "variant")), F.try_variant_get("_e", f"$.{n}", "int"))
    rows = entries.where((_kind(F.col("_e")) == "OBJECT") & is_number(box))
    rows = rows.select(key, "id", whole("box").alias("box"), F.when(_kind(due) == "STRING", F.try_variant_get("_e", "$.due", "string")).alias("due"), F.coalesce(whole("correct"), F.lit(0)).alias("correct"), F.coalesce(whole("wrong"), F.lit(0)).alias("wrong"))
    return rows, d.where(~F.col("_good") & (F.trim(F.coalesce(F.col(value), F.lit(""))) != "")).select(key, value)


def newest(mine: DataFrame, theirs: DataFrame, key: list[str], at: str) -> DataFrame:
    """Every key once, with the later record and ``theirs`` (is it the other copy's); at one time, mine."""
    fields = [c for c in mine.columns if c not in key]
    side = lambda df, n: df.select(*key, F.struct(*fields).alias(n))
    j = side(mine, "_m").join(side(theirs, "_t"), key, "full")
    other = F.col("_m").isNull() | (F.col("_t").isNotNull() & (F.coalesce(F.col(f"_t.{at}").cast("string"), F.lit("")) > F.coalesce(F.col(f"_m.{at}").cast("string"), F.lit(""))))
    return j.select(*key, F.when(other, F.col("_t")).otherwise(F.col("_m")).alias("_x"), other.alias("theirs")).select(*key, "_x.*", "theirs")


def earliest(mine: DataFrame, theirs: DataFrame, key: list[str], at: str) -> DataFrame:
    return mine.select(*key, at).unionByName(theirs.select(*key, at)).groupBy(*key).agg(F.min(at).alias(at))


def latest_union(mine: DataFrame, theirs: DataFrame, key: list[str], id_: str, at: str, most: int = EXAMS) -> DataFrame:
    """The latest ``most`` records of each key out of both copies; of one id, mine."""
    rows = mine.withColumn("_side", F.lit(0)).unionByName(theirs.withColumn("_side", F.lit(1)))
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key, id_).orderBy("_side"))).where("_r = 1")
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(at), id_)
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "_side")


def attempts(log: DataFrame, key: list[str]) -> DataFrame:
    """key, solved, gave_up (once is for ever), attempts and the last time, out of (key, solved, gave_up, at)."""
    return log.groupBy(*key).agg(F.bool_or("solved").alias("solved"), F.bool_or("gave_up").alias("gave_up"), F.count("*").alias("attempts"), F.max("at").alias("at"))


def exam_order(exams: DataFrame, key: str, day: str, created: str, today: Column) -> DataFrame:
    """exams with ``place``: those to come by date, today's first, then the past ones from the latest. Place 1 is nearest."""
    past = F.col(day) < today
    w = Window.partitionBy(key).orderBy(past, F.when(~past, F.col(day)), F.desc(day), created)
    return exams.withColumn("place", F.row_number().over(w))


def wrong_by_node(answers: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, node, questions, wrong, place: questions whose last answer was wrong, by node; the nodes with most wrong answers
    first, then in the order of the tree. answers: key, node, last (was it right), wrong; nodes: node, order."""
    g = answers.where("last = false").groupBy(key, "node").agg(F.count("*").alias("questions"), F.sum("wrong").alias("wrong"))
    w = Window.partitionBy(key).orderBy(F.desc("wrong"), "order")
    return g.join(nodes.select("node", "order"), "node").select(key, "node", "questions", "wrong", F.row_number().over(w).alias("place"))


def group_status(children: DataFrame, parent: str) -> DataFrame:
    """parent, done, total, active out of (parent, status): empty children do not count."""
    real = F.col("status") != "empty"
    return children.groupBy(parent).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(real).alias("total"), F.coalesce(F.bool_or(F.col("status") == "learning"), F.lit(False)).alias("active"))


def nth_study_day(start: Column, k: Column, weekdays: list[int]) -> Column:
    """The day number of the k-th study day from ``start`` on; weekdays from 0, a Sunday. None or k < 1: null."""
    days = sorted(set(weekdays))
    if not days:
        return F.lit(None).cast("long")
    weeks = F.floor((k - 1) / len(days))
    first = start + weeks * 7
    week = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.pmod(first + i + 4, F.lit(7)).cast("int").isin(*days))
    return F.when(k >= 1, first + F.get(week, (k - 1 - weeks * len(days)).cast("int"))).cast("long")


def kept_days(log: DataFrame, day: str, today: Column, keep: int = LOG_DAYS) -> DataFrame:
    """The last ``keep`` days, today among them, and whatever lies ahead."""
    return log.where(F.col(day) >= F.date_sub(today, keep - 1))


def stale_days(log: DataFrame, day: str, today: Column, keep: int = USAGE_DAYS) -> DataFrame:
    return log.where(F.col(day) < F.date_sub(today, keep))


def review_minutes(count: Column, ms: Column, reviews: Column) -> Column:
    """Minutes that so many reviews take, at the mean of the recent ones (ms, reviews) or the usual time; rounded up."""
    each = F.when((reviews > 0) & (ms > 0), ms / reviews).otherwise(F.lit(REVIEW_SECONDS * 1000.0))
    return F.when(count > 0, F.ceil(F.floor(count) * each / 60000.0)).otherwise(0).cast("long")


def reading_log(records: DataFrame, key: list[str]) -> DataFrame:
    """key, day, bucket, ms, chars, pages: what was read, added up. Records of no date or of an unknown bucket do not count,
    numbers below zero count as zero."""
    day = F.col("day").try_cast("date")
    some = lambda c: F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).alias(c)
    good = records.withColumn("_d", day).where(F.col("_d").isNotNull() & F.col("bucket").isin(*BUCKETS))
    return good.groupBy(*key, F.date_format("_d", "yyyy-MM-dd").alias("day"), "bucket").agg(some("ms"), some("chars"), some("pages"))


def bucket_for(mode: Column, source_too: Column) -> Column:
    return F.when(~mode.eqNullSafe(F.lit("speak")), "src").when(source_too == F.lit(False), "tr").otherwise("both")


def calls_rate(measured: Column, bucket: Column) -> Column:
    """Calls for 10,000 characters: none where nothing is translated, else the measured or the usual number."""
    return F.when(bucket == "src", 0.0).when(measured >= 0, measured).otherwise(CALLS)


def clamp(v: Column, lo: int | float, hi: int | float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def new_per_day(setting: Column) -> Column:
    """New cards a day out of a setting's text; what is no number is the usual one."""
    n = F.trim(setting).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), NEW_CARDS).otherwise(clamp(F.floor(n), 0, MOST_NEW)).cast("int")


def warn_threshold(cap: Column, share: Column) -> Column:
    """The count at which to warn of a daily limit; null for a share that is not between 0 and 1."""
    return F.when((share > 0) & (share < 1), F.greatest(F.lit(1), F.ceil(cap * share - 1e-9))).cast("long")


def backup_age(last: Column, now: Column) -> tuple[Column, Column]:
    """(calendar days since, is that too long): null and null where there was none."""
    days = F.greatest(F.lit(0), F.datediff(now, last))
    return days, days > STALE_DAYS


def countdown(started_ms: Column, limit_seconds: Column, now_ms: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil((started_ms + limit_seconds * 1000 - now_ms) / 1000)).cast("long")
