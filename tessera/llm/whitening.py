"""Whitening of embeddings: streaming moments of partitions, merged pair by pair, then a symmetric QR eigen-solve.

Each partition's iterator keeps a count, a mean and a matrix of centred products, which every vector updates by one
rank-one term (Welford). Partitions' states are merged by the parallel update formula, MERGED at a time, until one is left;
so the driver holds one matrix of dimensions x dimensions, whatever the number of vectors. Sums are kept as whole numbers
too, so what is said of them is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved, lean

#: States that one task merges at a time, each a matrix of dimensions x dimensions.
MERGED = 8

STATE = "part long, n long, mean array<double>, products array<double>, sums array<string>"
_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64())), ("sums", pa.list_(pa.string()))])


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(256 c) of each component as a whole number of 64 bits (beyond them the greatest or least), without
    vectors that are null or hold a null or non-finite component. Shorter vectors end in zeros."""
    c = F.col("embedding").cast("array<double>")
    ok = c.isNotNull() & F.forall(c, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda y: F.floor(y * 256.0)).alias("x"))
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(col), width)


def _exact_sums(m: np.ndarray) -> list[int]:
    if float(np.abs(m.astype(np.float64)).max(initial=0)) * len(m) < 2.0**62:
        return m.sum(0).tolist()
    return [sum(x) for x in m.T.tolist()]


class Moments:
    """Count, mean and centred products of rows that come one by one; two of them add up to that of all rows."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)))

    def take(self, row: np.ndarray) -> None:
        self.n += 1
        off = row - self.mean
        self.mean += off / self.n
        self.products += np.multiply.outer(off, row - self.mean)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        off = other.mean - self.mean
        return Moments(n, self.mean + off * (other.n / n), self.products + other.products + np.multiply.outer(off, off) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


def _state(part: int, m: Moments, sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "n": [m.n], "mean": [m.mean], "products": [m.products.ravel()], "sums": [list(map(str, sums))]}, schema=_STATE)


def moments(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray] = lambda x: x.astype(np.float64)) -> tuple[Moments, list[int]]:
    """Moments of the rows that ``of`` makes out of the whole vectors of ``fit`` (x), and the exact sums of those vectors."""

    @lean
    def partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, [0] * width
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), width)
                sums = [s + x for s, x in zip(sums, _exact_sums(m), strict=True)]
                rows = of(m)
                own = own or Moments.none(rows.shape[1])
                for row in rows:
                    own.take(row)
        if own:
            yield _state(TaskContext.get().partitionId(), own, sums)

    def merged(t: pa.Table) -> pa.Table:
        all_, sums = None, [0] * width
        for r in t.sort_by("part").to_batches(max_chunksize=1):
            mean = r.column("mean").flatten().to_numpy()
            one = Moments(r.column("n")[0].as_py(), mean, r.column("products").flatten().to_numpy().reshape(len(mean), len(mean)))
            all_ = all_.merge(one) if all_ else one
            sums = [s + int(x) for s, x in zip(sums, r.column("sums")[0].as_py(), strict=True)]
        return pa.Table.from_batches([_state(t.column("part")[0].as_py() // MERGED, all_, sums)])

    states = Saved(fit.select("x").mapInArrow(partition, STATE))
    last = states.df.agg(F.max("part")).first()[0]
    while last:
        states, before = Saved(states.df.groupBy(F.expr(f"part div {MERGED}")).applyInArrow(merged, STATE)), states
        before.drop()
        last //= MERGED
    row = states.df.first()
    states.drop()
    if row is None:
        return Moments.none(0), []
    mean = np.array(row.mean)
    return Moments(row.n, mean, np.array(row.products).reshape(len(mean), len(mean))), [int(x) for x in row.sums]


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows: reflections make it tridiagonal, then
    implicitly shifted QR steps (Wilkinson's shift) drive the elements beside the diagonal to zero."""
    n = len(a)
    a = np.array(a, np.float64)
    q = np.eye(n)  # rows, so that a rotation works on two runs of memory
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(math.sqrt(v @ v), v[0])
        size = math.sqrt(v @ v)
        if size:
            v /= size
            a[k + 1 :] -= 2 * np.multiply.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.multiply.outer(a[:, k + 1 :] @ v, v)
            q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    d, e = a.diagonal().tolist(), a.diagonal(-1).tolist()
    eps = np.finfo(np.float64).eps

    def gone(i: int) -> bool:
        return abs(e[i]) <= eps * (abs(d[i]) + abs(d[i + 1]))

    hi = n - 1
    while hi > 0:
        if gone(hi - 1):
            e[hi - 1] = 0.0
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and not gone(lo - 1):
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        x = d[lo] - d[hi] + e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        z = e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            d0, d1, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * d0 + 2 * c * s * f + s * s * d1, s * s * d0 - 2 * c * s * f + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * f
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = sorted(range(n), key=lambda i: -d[i])
    return np.array([d[i] for i in order]), q[order]


OUT = "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("deviation_digits", pa.string()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Of each usable row of ``vectors`` (vec_id, embedding) and each of the first components: the whitened value and what
    belongs to it; the model is fitted to the distinct quantized vectors.

    ``deviation`` is the exact sum of (n x - S)^2 over the dimensions, null where 64 bits do not hold it; the same in digits
    always. Fewer dimensions than ``components`` give fewer rows. A component without spread (one vector, equal vectors)
    has a null ``whitened`` and takes no part in ``identity_error``, which is null if none has spread; ``explained`` is null
    if nothing has spread. Null vectors, and those with a null or non-finite component, have no row; rows that share an id,
    or have none, each have theirs; other columns take no part. No usable rows: no result.
    """
    rows = quantized(vectors)
    fit = Saved(rows.select("x").distinct())
    width = fit.df.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        fit.drop()
        return vectors.sparkSession.createDataFrame([], OUT)
    whole, sums = moments(fit.df, width)
    n, trace = whole.n, float(np.trace(whole.covariance()))
    e, vectors_ = symmetric_qr(whole.covariance())
    top = min(components, width)
    spread = e[:top] > width * np.finfo(np.float64).eps * max(trace, 0.0)
    axes = np.where(spread[:, None], vectors_[:top] / np.sqrt(np.where(spread, e[:top], 1.0))[:, None], np.nan)
    explained = [float(x) / trace if trace > 0 else None for x in e[:top]]
    greatest = max(map(abs, sums))

    def offsets(m: np.ndarray) -> np.ndarray:
        """n x - S, exact: as 64-bit numbers where they and their squares' sums fit, else as whole numbers of any size."""
        reach = float(np.abs(m.astype(np.float64)).max(initial=0)) * n + greatest
        if reach * reach * width < 2.0**62:
            return m * n - np.array(sums, np.int64)
        return m.astype(object) * n - np.array(sums, object)

    def project(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / n) @ axes.T

    kept = np.flatnonzero(spread)
    error = None
    if len(kept):
        white, _ = moments(fit.df, width, lambda m: project(offsets(m))[:, kept])
        error = float(np.abs(white.covariance() - np.eye(len(kept))).max())
    fit.drop()

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = offsets(_matrix(b.column(1), width))
                exact = (y * y).sum(1).tolist()
                value = project(y).ravel()
                k = b.num_rows
                fits = [x if x < 2**63 else None for x in exact]
                columns = [
                    b.column(0).take(pa.array(np.repeat(np.arange(k), top))),
                    pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * top, n, np.int64)),
                    pa.array([x for x in fits for _ in range(top)], pa.int64()),
                    pa.array([x for s in map(str, exact) for x in [s] * top], pa.string()),
                    pa.array(value, mask=np.isnan(value)),
                    pa.array(explained * k, pa.float64()),
                    pa.array([error] * (k * top), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return rows.mapInArrow(run, OUT)
