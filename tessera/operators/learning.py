"""Learning schedules folded from histories of answers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days until a box is due again; the fourth box is done.
BOX_DAYS = {1: 1, 2: 3, 3: 7}
EASE, EASE_MIN, LONGEST = 2.5, 1.3, 365
DELTA = {"again": -0.2, "hard": -0.15, "good": 0.0, "easy": 0.15}


def boxes(answers: DataFrame, key: str = "user_id") -> DataFrame:
    """key, box, correct, wrong, due: Leitner boxes out of (key, at, seq, correct). A right answer moves up one, a wrong
    one back to the first; the first answer counts from box one. So the box is one more than the right answers since the
    last wrong one, four at most: two aggregations, no ordered fold."""
    last = answers.groupBy(key).agg(F.max(F.when(~F.col("correct"), F.struct("at", "seq"))).alias("w"), F.max("at").alias("at"), F.count_if(F.col("correct")).alias("right"), F.count_if(~F.col("correct")).alias("wrong"))
    run = answers.where("correct").join(last.select(key, "w"), key).where(F.col("w").isNull() | (F.struct("at", "seq") > F.col("w"))).groupBy(key).agg(F.count("*").alias("run"))
    out = last.join(run, key, "left").withColumn("box", F.least(F.lit(4), 1 + F.coalesce("run", F.lit(0))).cast("int"))
    days = F.when(F.col("box") == 1, BOX_DAYS[1]).when(F.col("box") == 2, BOX_DAYS[2]).when(F.col("box") == 3, BOX_DAYS[3])
    return out.select(key, "box", F.col("right").alias("correct"), "wrong", F.date_add(F.to_date("at"), days).cast("string").alias("due"))


def _two(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def review(state: tuple[float, int, int, int], grade: str) -> tuple[float, int, int, int]:
    """(ease, interval in days, repetitions, lapses) after one grade."""
    ease, days, reps, lapses = state
    ease = max(EASE_MIN, _two(ease + DELTA[grade]))
    if grade == "again":
        return ease, 0, 0, lapses + 1
    if reps == 0:
        n = 4 if grade == "easy" else 1
    elif grade == "good" and reps == 1:
        n = 6
    else:
        n = max(days + 1, math.floor(days * {"hard": 1.2, "good": ease, "easy": ease * 1.3}[grade] + 0.5))
        if grade == "easy" and reps == 1:
            n = max(7, n)
    return ease, min(n, LONGEST), reps + 1, lapses


def schedule(reviews: DataFrame, key: str = "user_id") -> DataFrame:
    """key, ease, days, reps, lapses after all of (key, at, seq, grade): each key's rows pass by in order, and only its state is held."""

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (EASE, 0, 0, 0)
        for b in batches:
            out = []
            for k, g in zip(b[key], b["grade"]):
                if k != now:
                    if now is not None:
                        out.append((now, *state))
                    now, state = k, (EASE, 0, 0, 0)
                state = review(state, g)
            yield pd.DataFrame(out, columns=[key, "ease", "days", "reps", "lapses"])
        if now is not None:
            yield pd.DataFrame([(now, *state)], columns=[key, "ease", "days", "reps", "lapses"])

    rows = reviews.where(F.col("grade").isin(*DELTA) & F.col(key).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "at", "seq").select(key, "grade").mapInPandas(fold, f"{key} {dict(reviews.dtypes)[key]}, ease double, days long, reps long, lapses long")


def previews(ease: Column, days: Column, reps: Column) -> Column:
    """array(grade, days): the interval that each grade would give a card, without a fold."""

    def after(grade: str) -> Column:
        e = F.greatest(F.lit(EASE_MIN), F.floor((ease + F.lit(DELTA[grade])) * 100 + 0.5) / 100)
        if grade == "again":
            return F.lit(0).cast("long")
        rate = {"hard": F.lit(1.2), "good": e, "easy": e * 1.3}[grade]
        more = F.greatest(days + 1, F.floor(days * rate + 0.5))
        if grade == "easy":
            more = F.when(reps == 1, F.greatest(F.lit(7), more)).otherwise(more)
        if grade == "good":
            more = F.when(reps == 1, 6).otherwise(more)
        return F.least(F.when(reps == 0, 4 if grade == "easy" else 1).otherwise(more), F.lit(LONGEST)).cast("long")

    return F.array(*[F.struct(F.lit(g).alias("grade"), after(g).alias("days")) for g in DELTA])


def unit_key(doc: Column, line: Column, source: Column, index: Column) -> Column:
    """What makes two events one unit: the line and the text, or where there is no line the number."""
    return F.concat_ws("|", doc, F.when(line.isNotNull() & (line != ""), F.concat_ws("|", F.concat(F.lit("L"), line), source)).otherwise(F.concat(F.lit("i"), index.cast("string"))))


def shuffled(rows: DataFrame, key: str, id_: str, seed: int) -> DataFrame:
    """rows with ``place``: an order by chance inside each key that the seed repeats on any number of machines."""
    dice = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(dice, id_)))
