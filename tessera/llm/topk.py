"""Exact top-k by inner product with block-at-a-time pruning.

Rows stand in blocks of consecutive ids. Each block has, for each term (dimension), the least and greatest value; a
query's bound for a block is the sum over its terms of the value that gives most. A query takes the blocks by falling
bound and scores whole blocks through their forward index (the block's matrix), until the next bound is below its k-th
best score; a bound equal to it is still scored, as a tie may have a smaller id.

Blocks are dealt to shards of SHARD rows and queries to squads of SQUAD; a task searches one shard for one squad, and only
each task's k best for a query are shuffled on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, SHARD, SQUAD = 128, 16384, 8192
#: Shards that are ranges of ids; beyond, blocks of ids are dealt in turn.
RANGES = 4096
FOUND = "query_id long, vec_id long, score long, digits string, place string"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("digits", pa.string()), ("place", pa.string())])


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the components as doubles, of which floor(SCALE x) is taken where they are multiplied; without vectors
    that are null or hold a null or non-finite component, or have no id."""
    x = F.col("embedding").cast("array<double>")
    ok = x.isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(ok & F.col("vec_id").isNotNull()).select("vec_id", F.col("x").alias("v"))


SCALE = 256


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of floor(SCALE x), exact: whole doubles, or numbers of any size where SCALE x is beyond doubles. Shorter vectors
    end in zeros."""
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    n = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    if np.abs(out).max(initial=0) < 2.0**1000:
        return np.floor(out * SCALE)
    return _whole(out, lambda x: int(x) * SCALE if abs(x) >= 2.0**60 else math.floor(x * SCALE))


def _whole(m: np.ndarray, of=int) -> np.ndarray:
    out = np.empty(m.shape, object)
    out.ravel()[:] = [of(x) for x in m.ravel().tolist()]
    return out


def sort_key(x: int) -> str:
    """A string that sorts as the whole number does: sign, how many digits, digits, all turned about below zero."""
    digits = str(abs(x))
    s = f"{len(digits):04d}{digits}"
    return "1" + s if x >= 0 else "0" + s.translate(_TURNED)


_TURNED = str.maketrans("0123456789", "9876543210")


def _search(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    most = [int(np.abs(x).max(initial=0)) for x in (m, q)]
    top = most[0] * most[1] * m.shape[1]
    if top >= 2**53:  # below, whole numbers stay exact in floating point, which multiplies matrices faster
        if max(top, *most) < 2**62:
            m, q = m.astype(np.int64), q.astype(np.int64)
        else:  # beyond 64 bits: whole numbers of any size
            m, q = (x if x.dtype == object else _whole(x) for x in (m, q))
    cuts = list(range(0, len(ids), BLOCK))
    hi = np.stack([m[a : a + BLOCK].max(0) for a in cuts])
    lo = np.stack([m[a : a + BLOCK].min(0) for a in cuts])
    bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    out: tuple[list, list, list] = ([], [], [])
    m, q = np.ascontiguousarray(m), np.ascontiguousarray(q)
    for i in range(len(qids)):
        best_s, best_id = np.zeros(0, m.dtype), np.zeros(0, np.int64)
        for j in turn[i]:
            if len(best_s) == k and bound[i, j] < best_s[-1]:
                break
            a = cuts[j]
            s, own = m[a : a + BLOCK] @ q[i], ids[a : a + BLOCK]
            use = own != qids[i]
            if len(best_s) == k:
                use &= s >= best_s[-1]
            if use.any():
                s, own = np.concatenate([best_s, s[use]]), np.concatenate([best_id, own[use]])
                keep = np.lexsort((own, -s))[:k]
                best_s, best_id = s[keep], own[keep]
        out[0].extend([int(qids[i])] * len(best_s))
        out[1].extend(best_id.tolist())
        out[2].extend(int(x) for x in best_s)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, digits: for each query (vec_id, v) the k rows of ``vectors`` (vec_id, v) with the greatest
    inner products of whole numbers floor(SCALE v), ties to the smaller vec_id. ``score`` is null where 64 bits do not hold
    it; ``digits`` has it always, and ranks are by the exact number. Rows with the query's own id are no candidates; of rows that share an id
    each takes part. Vectors may differ in length (missing components count as zero). No rows or no queries: no result.
    """
    n, m = vectors.count(), queries.count()
    shards, squads = max(1, -(-n // SHARD)), max(1, -(-m // SQUAD))
    ends = vectors.agg(F.percentile_approx("vec_id", [i / shards for i in range(1, shards)], 50 * shards)).first()[0] if 1 < shards <= RANGES else []
    if shards <= RANGES:  # shards of consecutive ids, by quantiles
        shard = F.size(F.filter(F.lit(ends or []).cast("array<bigint>"), lambda e: e < F.col("vec_id")))
    else:
        shard = F.pmod(F.expr(f"vec_id div {BLOCK}"), F.lit(shards)).cast("int")
    rows = vectors.select("vec_id", "v", shard.cast("int").alias("shard")).withColumn("squad", F.explode(F.sequence(F.lit(0), F.lit(squads - 1))))
    # under names of their own: where both sides are made of one table, a cogroup takes equal columns for one
    asks = queries.select(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked"), F.pmod(F.xxhash64("vec_id"), F.lit(squads)).cast("int").alias("squad")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        width = max(len(x) for c in (left.column("v"), right.column("asked")) for x in c)
        asked, found, scores = _search(left.column("vec_id").to_numpy(), _matrix(left.column("v"), width), right.column("asked_id").to_numpy(), _matrix(right.column("asked"), width), k)
        fits = [x if -(2**63) <= x < 2**63 else None for x in scores]
        return pa.Table.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(fits, pa.int64()), pa.array(list(map(str, scores)), pa.string()), pa.array(list(map(sort_key, scores)), pa.string())], schema=_FOUND)

    found = rows.groupBy("shard", "squad").cogroup(asks.groupBy("shard", "squad")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "digits")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k() of (vec_id, embedding) with the rows whose id is divisible by ``every`` as queries."""
    q = quantized(vectors)
    asked = q.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows that share an id, the least vector asks
    return top_k(q, asked, k)
