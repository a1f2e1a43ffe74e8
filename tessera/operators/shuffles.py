"""Fisher and Yates' shuffle by a seeded generator, in the very order that a loop would give, without a loop.

The generator's k-th number is a function of seed and k alone, so all swaps of a group are known at once: step i (from the
last place down to 1) swaps places i and j(i) <= i. What ends at place i stood at j(i) just before step i. Only an earlier
step i' > i can have put something there, the least i' with j(i') = j(i), and that was what stood at i' just before; so
where an item comes from is a chain of such steps, and following chains by doubling takes a few joins for a group of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.study import mulberry32
from tessera.session import stored

#: What the generator's state grows by with each number.
STEP = 0x6D2B79F5


def drawn(df: DataFrame, seed: str, nth: str, name: str) -> DataFrame:
    """df with the nth number (from 1), in 0..1, of the generator with each row's seed."""
    state = F.pmod(F.col(seed).cast("long") + (F.pmod(F.col(nth).cast("long") - 1, F.lit(1 << 32)) * STEP), F.lit(1 << 32))
    return df.withColumn("_state", state).withColumn(name, mulberry32("_state")).drop("_state")


def fisher_yates(rows: DataFrame, key: list[str], order: list[str], seed: str = "seed", skip: str | None = None) -> DataFrame:
    """rows with ``place`` (from 1): each group's rows, taken in ``order``, shuffled by the generator of its ``seed`` after
    ``skip`` numbers were drawn from it. Of rows that are equal in order, which comes first is not said."""
    w = Window.partitionBy(*key)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    r = r.withColumn("_nth", F.coalesce(F.col(skip), F.lit(0)) + F.col("_n") - F.col("_i") if skip else F.col("_n") - F.col("_i"))
    swap = F.when(F.col("_i") > 0, F.floor(F.col("_r") * (F.col("_i") + 1))).otherwise(0).cast("int")
    r = stored(drawn(r, seed, "_nth", "_r").withColumn("_j", swap).drop("_r", "_nth"))
    steps = r.select(*key, "_i", "_j")
    writer = F.lead("_i").over(Window.partitionBy(*key, "_j").orderBy("_i"))  # who last wrote to place j before step i
    starts = steps.select(*key, F.col("_i").alias("_to"), "_j", writer.alias("_at"))
    # what stood at place i just before step i was put there by the least later step that swaps with i
    first = steps.where("_i > _j").groupBy(*key, F.col("_j").alias("_i")).agg(F.min("_i").alias("_up"))
    up = stored(steps.select(*key, "_i").join(first, [*key, "_i"], "left").select(*key, "_i", F.coalesce("_up", "_i").alias("_up")))
    while not up.join(up.select(*key, F.col("_i").alias("_up"), F.col("_up").alias("_top")), [*key, "_up"]).where("_top <> _up").isEmpty():
        up = stored(up.join(up.select(*key, F.col("_i").alias("_up"), F.col("_up").alias("_top")), [*key, "_up"]).select(*key, "_i", F.col("_top").alias("_up")))
    came = starts.join(up.select(*key, F.col("_i").alias("_at"), "_up"), [*key, "_at"], "left")
    came = came.select(*key, F.coalesce("_up", "_j").alias("_i"), (F.col("_to") + 1).alias("place"))
    return r.join(came, [*key, "_i"]).select(*rows.columns, "place")


def exam(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """exam, place, node, id: questions (node, id) of each exam (exam, seed, n): every node's questions are shuffled, node after
    node, then the nodes; then each node in turn gives its next one, until n are taken or none is left. One generator an exam
    goes through all of it, so an exam is its seed's."""
    pools = questions.groupBy("node").agg(F.count("*").alias("_size"))
    w = Window.partitionBy("exam").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    nodes = pools.join(F.broadcast(exams.select("exam", "seed", "n")))  # every exam asks about every node; exams are a stated set
    nodes = stored(nodes.withColumn("skip", F.coalesce(F.sum(F.col("_size") - 1).over(w), F.lit(0))))
    all_ = Window.partitionBy("exam")
    turn = nodes.withColumn("skip", F.sum(F.col("_size") - 1).over(all_))
    turn = fisher_yates(turn.select("exam", "seed", "node", "skip"), ["exam"], ["node"], skip="skip").select("exam", "node", F.col("place").alias("_turn"))
    own = fisher_yates(questions.join(nodes.select("exam", "seed", "n", "node", "skip"), "node"), ["exam", "node"], ["id"], skip="skip")
    order = Window.partitionBy("exam").orderBy("place", "_turn")
    out = own.join(turn, ["exam", "node"]).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("n"))
    return out.select("exam", F.col("_at").alias("place"), "node", "id")
