"""A quality classifier as a sparse rule ensemble, compiled into Spark column expressions.

Statistics of the text (DataFrame functions only) feed small boosted trees; every path from a tree's root is a rule, a
conjunction of bounds on statistics; lasso logistic regression weighs the rules and drops most. What is left is one SQL
expression over the statistics, so scoring stays in the JVM.

Fitting sees a bounded sample of labelled rows: the MOST rows least by a hash of doc_id, of those that may be learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most.
MOST = 20_000
#: Trees, their depth, bins of a statistic, rules that may carry weight at most.
TREES, DEPTH, BINS, RULES = 40, 3, 32, 60
#: Frequent function words of the languages at hand (fixed values).
STOP = "the of and to in a is that it for was on with be by as at are this der die und das von zu mit ist nicht ein eine den dem le la les de des et un une en du que est dans pour par el los las y del se su con para al"

_WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, by name; those of a null or empty text are all zero. They use columns made by prepared()."""
    n, w = F.greatest(F.col("_n"), F.lit(1.0)), F.greatest(F.size("_w").cast("double"), F.lit(1.0))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    of_words = lambda f: F.size(F.filter("_w", f)).cast("double")
    lines = F.greatest(F.size("_l").cast("double"), F.lit(1.0))
    return {
        "s_words": F.log1p(F.size("_w").cast("double")),
        "s_word_length": F.col("_n") / w,
        "s_upper": count(r"\p{Lu}") / n,
        "s_digits": count(r"\p{Nd}") / n,
        "s_signs": count(r"[^\p{L}\p{N}\s]") / n,
        "s_marks": count(r"[#$%&*@^~<>{}\\=+]") / n,
        "s_shouts": count(r"[!?]") / w,
        "s_bars": count(r"[|]") / w,
        "s_ends": count(r"[.!?](?:\s|$)") / w,
        "s_stops": of_words(lambda x: F.lower(x).isin(*sorted(set(STOP.split())))) / w,
        "s_distinct": F.size(F.array_distinct("_w")) / w,
        "s_same_lines": 1.0 - F.size(F.array_distinct("_l")) / lines,
        "s_line_words": w / lines,
        "s_links": count(r"https?://|www\.") / w,
    }


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, statistics): the input row as a struct, so that no name can clash."""
    t = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", t.alias("_t"), F.length(t).cast("double").alias("_n"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("_w"), F.split(t, "\n").alias("_l"))
    return d.select("row", *[c.alias(k) for k, c in statistics(F.col("_t")).items()])


@dataclass(frozen=True)
class Rule:
    """All of: statistic <= bound (or >, if not upto)."""

    terms: tuple[tuple[str, float, bool], ...]
    weight: float

    def sql(self) -> str:
        return " AND ".join(f"{name} {'<=' if upto else '>'} {bound!r}D" for name, bound, upto in self.terms)


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, over the columns of prepared()."""
        return F.expr("1D / (1D + exp(-(" + " + ".join([f"{self.bias!r}D", *(f"IF({r.sql()}, {r.weight!r}D, 0D)" for r in self.rules)]) + ")))")


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> None:
    """Grow on binned statistics by gradient and hessian; out gets (path, rows, leaf value)."""
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    if path:
        out.append((path, rows, value, depth == 0))
    if not depth or len(rows) < 20:
        if path and depth:
            out[-1] = (path, rows, value, True)
        return
    best = (1e-6, -1, -1)
    G, H = g[rows].sum(), h[rows].sum()
    for j in range(x.shape[1]):
        gl = np.cumsum(np.bincount(x[rows, j], g[rows], BINS))[:-1]
        hl = np.cumsum(np.bincount(x[rows, j], h[rows], BINS))[:-1]
        n = np.cumsum(np.bincount(x[rows, j], minlength=BINS))[:-1]
        gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
        gain[(n < 8) | (n > len(rows) - 8)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        if path:
            out[-1] = (path, rows, value, True)
        return
    left = x[rows, j] <= k
    _tree(x, g, h, rows[left], depth - 1, (*path, (j, k, True)), out)
    _tree(x, g, h, rows[~left], depth - 1, (*path, (j, k, False)), out)


class _Bits:
    """Which rows meet which rules, a bit each; products with it unpack some rows at a time, so memory stays small."""

    def __init__(self, packed: np.ndarray, rules: int):
        self.packed, self.rules = packed, rules
        self.mean = sum(x.sum(0, dtype=np.float64) for _, x in self.blocks()) / max(1, len(packed))
        self.sd = np.maximum(np.sqrt(self.mean * (1 - self.mean)), 1e-3)

    def blocks(self):
        for at in range(0, len(self.packed), 2048):
            yield slice(at, at + 2048), np.unpackbits(self.packed[at : at + 2048], axis=1, count=self.rules).astype(np.float32)

    def both(self, v: np.ndarray, inner) -> tuple[np.ndarray, float]:
        """z.T @ e and sum(e) for e = inner(rows, z @ v), z being the standardized rules."""
        x, out, total = (v / self.sd).astype(np.float32), np.zeros(self.rules), 0.0
        base = float(self.mean @ (v / self.sd))
        for rows, block in self.blocks():
            e = inner(rows, block @ x - base)
            out += e.astype(np.float32) @ block
            total += float(e.sum())
        return (out - total * self.mean) / self.sd, total


def _lasso(r: _Bits, y: np.ndarray, lam: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty on standardized rules, by accelerated proximal gradient."""
    w, b = np.zeros(r.rules), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, vb, t = w.copy(), b, 1.0
    u, norm = np.ones(r.rules), 1.0
    for _ in range(20):  # the greatest eigenvalue bounds the step
        u = r.both(u, lambda rows, s: s)[0]
        norm = max(float(np.linalg.norm(u)), 1e-12)
        u /= norm
    step = 4.0 / (norm / len(y) + 1.0)
    for _ in range(steps):
        g, total = r.both(v, lambda rows, s: 1 / (1 + np.exp(-np.clip(s + vb, -30, 30))) - y[rows])
        nw = v - step * g / len(y)
        nb = vb - step * total / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lam, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b - (w / r.sd) @ r.mean), w / r.sd


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Out of statistics and labels. One class or no rows: a constant score."""
    if len(y) < 40 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Ensemble(math.log(p / (1 - p)), ())
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)
    f = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, bytes] = {}
    turn = np.argsort(np.arange(len(y)) % 4 != 0, kind="stable")  # a quarter, which picks the penalty, comes first
    part = int((np.arange(len(y)) % 4 == 0).sum())
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        nodes: list = []
        _tree(binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), nodes)
        for path, rows, value, leaf in nodes:
            if leaf:
                f[rows] += 0.3 * value
            terms: dict[tuple, float] = {}
            for j, k, upto in path:  # the tightest bound of each side
                terms[j, upto] = min(terms.get((j, upto), k), k) if upto else max(terms.get((j, upto), k), k)
            key = tuple(sorted((j, k, upto) for (j, upto), k in terms.items()))
            if key not in found and len(rows) < len(y):
                hit = np.zeros(len(y), bool)
                hit[rows] = True
                found[key] = np.packbits(hit[turn]).tobytes()
    keys = list({raw: key for key, raw in reversed(found.items())}.values())[::-1]  # of rules that the same rows meet, the first
    if not keys:
        p = y.mean()
        return Ensemble(math.log(p / (1 - p)), ())
    columns = [np.unpackbits(np.frombuffer(found.pop(k), np.uint8), count=len(y)) for k in keys]
    packed = np.concatenate([np.packbits(np.stack([c[a : a + 2048] for c in columns], 1), axis=1) for a in range(0, len(y), 2048)])
    del columns
    y = y[turn]
    held, learn = _Bits(packed[:part], len(keys)), _Bits(packed[part:], len(keys))
    loss = {}
    for lam in (0.03, 0.01, 0.003, 0.001):
        b, w = _lasso(learn, y[part:], lam, 150)
        q = np.concatenate([x @ w.astype(np.float32) for _, x in held.blocks()])
        q = np.clip(1 / (1 + np.exp(-np.clip(b + q, -30, 30))), 1e-6, 1 - 1e-6)
        loss[lam] = -np.mean(y[:part] * np.log(q) + (1 - y[:part]) * np.log(1 - q))
    lam = min(loss, key=loss.get)
    r = _Bits(packed, len(keys))
    while True:
        b, w = _lasso(r, y, lam)
        if np.count_nonzero(w) <= RULES:
            break
        lam *= 1.6
    rules = [Rule(tuple((names[j], float(edges[j][k]), upto) for j, k, upto in keys[i]), float(w[i])) for i in np.flatnonzero(w)]
    return Ensemble(b, tuple(rules))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST) -> Ensemble:
    """From labels (doc_id, target) whose crc32(doc_id as text) mod 3 is not 1. Rows without a label or document do not
    count; of rows that share an id, the least label and the text with the least SHA-256 do."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    use = use.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(use), "doc_id")  # at most `most` rows of two numbers
    stats = prepared(rows)
    names = [c for c in stats.columns if c != "row"]
    digest = F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256)  # equal texts have equal statistics
    one = stats.groupBy("row.doc_id").agg(F.min(F.struct(digest.alias("t"), F.col("row.y").alias("y"), *names)).alias("x"))
    got = one.select("doc_id", "x.y", *[f"x.{n}" for n in names]).orderBy(F.xxhash64("doc_id")).toArrow()
    x = np.stack([got.column(n).to_numpy() for n in names], 1) if got.num_rows else np.zeros((0, len(names)))
    return fit_rules(names, x.astype(float), got.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(row, score): every row of docs with the score of its whole text.

    The score is a value, not an expression that a filter on it may take down to the scan: there each of its rules would
    hold the statistics' expressions once more. The partition's number, which is not deterministic, keeps it in place.
    """
    out = prepared(docs).select("row", model.score().alias("score"), F.spark_partition_id().alias("part"))
    return out.where("part >= 0").select("row", "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document. Null and empty texts have the score of zero statistics;
    a null doc_id is not held out; without labels every score is 0.5; an empty table gives an empty result."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
