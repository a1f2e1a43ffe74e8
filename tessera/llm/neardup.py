"""Near-duplicate removal by SimHash for a similarity (Jaccard of word shingles), not a number of bits.

Copies at similarity 0.8 differ in some 15 % of a SimHash's bits: 4 to 14 of 64, so a bound of 3 bits finds hardly any.
The same deletion variants therefore work on a wider fingerprint: 9 segments of 16 bits; at similarity 0.8 one of them
differs by at most one bit with probability 0.95 (0.99 at 0.85), and each is indexed with each bit as a wildcard. From 2^27
texts on segments are longer and more, by one rule (shape_for), so that buckets of unrelated texts stay small and the
probability stays as it is.

1. Who shares a key is compared on CHECK more bits. Texts that are close there, at once or by way of others, are a cluster
   of that key. Where the first bit is the wildcard, each emits one link, to the cluster's least; where another is, only
   the least of those that agree on that bit do, as the others have met under the first. No key emits more rows than it
   holds, and a crowd few.
2. Clusters of all keys are joined to groups (connected components). A group holds every pair that is close in any key.
3. In each group all pairs are verified inside one task, on the sets of their shingles: a matrix product counts what any
   two share. Only a spanning forest of the links that hold is emitted. Groups above BLOCK texts are dealt as pairs of
   blocks, so no task holds more than two blocks. Sets are whole up to SKETCH shingles; of a longer one the least hashes
   stand for it, and pairs within MARGIN of the bound that are not connected anyway are counted on all shingles.
4. The components of the links that hold are the groups of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved, Spans, buffers, lean, saved_here, slices, small_batches, splitmix
from tessera.llm.graph import components
from tessera.llm.simhash import LONG, document_words, majority, parts_of

#: Shortest segment, bits beside the segments that pairs are compared on, unrelated texts that share a bucket at most, about,
#: and the probability that a pair at the similarity shares one.
BITS, CHECK, BUCKET, RECALL = 16, 128, 4096, 0.945
#: Bits of CHECK that may differ in a pair worth verifying: similarity 0.8 has 19 in the mean, and 32 is three standard
#: deviations more; of unrelated pairs one in 10^8 is as close.
MOST = 32
#: Shingles up to which a set is kept whole; how far from the bound an estimate of longer ones decides: five standard
#: deviations (0.0125) at 0.8.
SKETCH, MARGIN = 1024, 0.0625
#: Texts of a group that one task verifies against each other or another block; parts of a text's shingles, by the first
#: four bits of their hash, so that no row is long.
BLOCK, PARTS = 1024, 16
#: Rows of keys that are looked at together, at least.
AT_ONCE = 10_000

_SEEDS = splitmix(np.arange(77, 77 + 8, dtype=np.uint64))


def shape_for(texts: int, similarity: float) -> tuple[int, int]:
    """(segments, bits of one) for so many texts. A bit of two SimHashes differs with the angle between the sets, in half turns."""
    bits = max(BITS, math.ceil(math.log2(max(1, texts) / BUCKET)) + 1)
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    close = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - close)), bits


def _shingles(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of each document (A-Z lower-cased), and each document's range in them: words by
    their bytes' running sums, shingles by their words'."""
    low, a, b, word = document_words(data, offs)
    n = np.diff(word)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not len(a):
        return np.zeros(0, np.uint64), out
    w = Spans(low).of(a, b)
    with np.errstate(over="ignore"):
        i = np.repeat(word[:-1] - out[:-1], count) + np.arange(out[-1])
        span = np.repeat(np.minimum(n, words), count)
        h = np.zeros(len(i), np.uint64)
        for j in range(words):
            part = w[np.minimum(i + j, len(w) - 1)]
            part[span <= j] = 0
            h = splitmix(h + part)
    return h, out


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """_shingles(), a long text a part at a time."""
    if len(offs) == 2 and len(data) > LONG:
        got = [_shingles(x, np.array([0, len(x)]), words)[0] for x in parts_of(data, words)]
        return np.concatenate(got), np.array([0, sum(map(len, got))])
    return _shingles(data, offs, words)


def wide_fingerprints(h: np.ndarray, out: np.ndarray, words: int) -> np.ndarray:
    """(documents, words) of 64 bits each, from shingle hashes and each document's range in them."""
    return np.stack([majority(splitmix(h ^ _SEEDS[w]), out) for w in range(words)], 1)


def _prints(docs: DataFrame, words: int, shape: tuple[int, int]) -> DataFrame:
    """(node, fp, sketch) of docs (thash, text). A fingerprint has the words of the segments, then those of CHECK, which begin in
    the segments' last."""
    wide = -(-shape[0] * shape[1] // 64) + CHECK // 64 - 1

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, 1):
            h, out = shingle_sets(*buffers(t.column(1)), words)
            fp = wide_fingerprints(h, out, wide)
            short = (h >> np.uint64(32)).astype(np.uint32)
            sketch = [np.unique(short[a:b])[:SKETCH].tobytes() for a, b in zip(out[:-1], out[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(sketch, pa.binary())], ["node", "fp", "sketch"])

    return docs.select("thash", "text").mapInArrow(run, "node long, fp binary, sketch binary")


def _begins(k: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])


def _by_key(batches: Iterable[pa.RecordBatch], shift: int = 0) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole keys, some at a time: (where each begins, and the end; their rows), out of batches that are sorted by the first
    column, whose last ``shift`` bits do not count. What is held of a key that goes on is put together once, when it ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    keys = lambda b: b.column(0).to_numpy() >> shift

    def done(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Table]:
        t = pa.Table.from_batches(rows).combine_chunks()
        return _begins(keys(t)), t

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        last = keys(b)[-1]  # its key may go on
        if rows < AT_ONCE or keys(held[0])[0] == last:
            continue
        rest: list[pa.RecordBatch] = []
        while held:
            b = held.pop()
            at = int(np.searchsorted(keys(b), last))
            if at < b.num_rows:
                rest.insert(0, b.slice(at))
            if at:
                held.append(b.slice(0, at))
                break
        yield done(held)
        held, rows = rest, sum(x.num_rows for x in rest)
    if held:
        yield done(held)


def clusters(begin: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row of its cluster: rows of one key (which go from one of begin to the next) that are within
    ``most`` bits of each other, at once or by way of others."""
    size = np.diff(begin)
    label = np.arange(begin[-1])
    small = size <= 64
    rows = np.flatnonzero(np.repeat(small, size))
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    i_all, j_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(size[small].max(initial=1))):
        rows = rows[place[rows] >= d]
        near = np.bitwise_count(fp[rows] ^ fp[rows - d]).sum(1, dtype=np.int32) <= most
        i_all.append(rows[near])
        j_all.append(rows[near] - d)
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        for x in (i, j, before[i], before[j]):
            np.minimum.at(label, x, least)
        label = label[label]
        if (label == before).all():
            break
    for s, e in zip(begin[:-1][~small], begin[1:][~small], strict=True):
        rest = np.arange(s, e)
        while len(rest):
            first, rest, todo = rest[0], rest[1:], [rest[0]]
            while todo and len(rest):
                near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]).sum(1, dtype=np.int32) <= most
                got, rest = rest[near], rest[~near]
                label[got] = first
                todo.extend(got.tolist())
    return label


def _close(prints: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Links (a, b) between distinct texts (node, fp) that connect each key's clusters. A key ends with the wildcard's bit,
    which does not count when keys are compared."""
    segments, bits = shape

    @lean
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        k = segments * bits
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                node = c.column(0).to_numpy()
                raw = b"".join(c.column(1).to_pylist())
                seg = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(node), -1), axis=1, count=k, bitorder="little").reshape(-1, segments, bits) @ ones
                check = np.frombuffer(raw, np.int64).reshape(len(node), -1)[:, -(CHECK // 64) :]
                keys = (seg[:, :, None] & ~ones) | (np.arange(k, dtype=np.uint64).reshape(1, segments, bits) << np.uint64(bits))
                keys = keys << np.uint64(1) | (seg[:, :, None] & ones != 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, k)), *[pa.array(np.repeat(x, k)) for x in check.T]], ["key", "node", "c0", "c1"])

    @lean
    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, t in _by_key(batches, 1):
            key, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            fp = np.stack([t.column(x).to_numpy() for x in (2, 3)], 1).view(np.uint64)
            own = np.arange(len(node))
            label, side = clusters(begin, fp, MOST), clusters(_begins(key), fp, MOST)
            other = np.flatnonzero((label != own) & ((side == own) | ((key >> 1 + bits) % bits == 0)))
            if len(other):
                links = np.unique(np.stack([node[label[other]], node[other]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    rows = prints.select("node", "fp").mapInArrow(spread, "key long, node long, c0 long, c1 long")
    return rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "node").mapInArrow(join, "a long, b long").distinct()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some sets share: products of 0/1 matrices, over values that stand in two sets at least."""
    m = len(sets)
    value = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(x) for x in sets])
    _, place, n = np.unique(value, return_inverse=True, return_counts=True)
    keep = n[place] > 1
    column = (np.cumsum(n > 1) - 1)[place[keep]]
    of = of[keep]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((m, m), np.float32)
    step = max(64, min(2048, (1 << 22) // m))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        x = np.zeros((m, step), np.float32)
        x[of[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def verify(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, is it sure) among sets of at most SKETCH values, those with SKETCH being samples: a spanning forest of the
    sure ones, and what is open between its trees."""
    m = len(sets)
    n = np.array([len(x) for x in sets], np.float32)
    both = _shared(sets)
    ok = both >= similarity * (n[:, None] + n - both) - 1e-4
    np.fill_diagonal(ok, False)
    open_ = np.zeros((0, 2), np.int64)
    long = n >= SKETCH
    if long.any():
        ok[long] = ok[:, long] = False
        maybe = np.triu((long[:, None] | long) & (both >= 0.4 * np.minimum(n[:, None], n)), 1)
        pairs = np.argwhere(maybe)
        share = np.zeros(len(pairs))
        for k, (i, j) in enumerate(pairs):
            u = np.union1d(sets[i], sets[j])[:SKETCH]
            top = u[-1] if len(u) >= SKETCH else np.iinfo(np.uint32).max
            share[k] = len(np.intersect1d(sets[i][: np.searchsorted(sets[i], top, "right")], sets[j][: np.searchsorted(sets[j], top, "right")], True)) / len(u)
        sure = pairs[share >= similarity + MARGIN]
        ok[sure[:, 0], sure[:, 1]] = ok[sure[:, 1], sure[:, 0]] = True
        open_ = pairs[np.abs(share - similarity) < MARGIN]
    tree = np.full(m, -1)
    a: list[int] = []
    b: list[int] = []
    for s in range(m):
        if tree[s] >= 0:
            continue
        tree[s], todo = s, [s]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(ok[i] & (tree < 0))
            tree[new] = s
            a += [i] * len(new)
            b += new.tolist()
            todo += new.tolist()
    open_ = open_[tree[open_[:, 0]] != tree[open_[:, 1]]]
    sure = np.arange(len(a) + len(open_)) < len(a)
    return np.concatenate([np.array(a, np.int64), open_[:, 0]]), np.concatenate([np.array(b, np.int64), open_[:, 1]]), sure


def _verified(groups: DataFrame, prints: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) that hold inside groups (node, root)."""
    size = groups.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = groups.join(size, "root").join(prints.select("node", "sketch"), "node").withColumn("x", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # block x meets every other block y once; a group of one block meets itself
    other = F.filter(F.sequence(F.lit(0), blocks - 1), lambda y: (y != F.col("x")) | (blocks == 1))
    rows = rows.select("node", "sketch", "root", "x", F.explode(other).alias("y"))
    rows = rows.select(F.xxhash64("root", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "node", "sketch")

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, t in _by_key(batches):
            node, raw = t.column(1).to_numpy(), t.column(2)
            for s, e in zip(begin[:-1], begin[1:], strict=True):
                i, j, sure = verify([np.frombuffer(x.as_buffer(), np.uint32) for x in raw[s:e]], similarity)
                if len(i):
                    own = node[s:e]
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j]), pa.array(sure)], ["a", "b", "sure"])

    found = Saved(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, sure boolean")).df
    sure, open_ = found.where("sure").select("a", "b"), found.where("NOT sure").select("a", "b").distinct()
    if open_.isEmpty():
        return sure
    return sure.unionByName(_counted(open_, texts, words, similarity))


def _counted(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) that have the similarity on all distinct shingles, which are dealt into PARTS by their hash."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, 1):
            h, out = shingle_sets(*buffers(t.column(1)), words)
            for node, a, b in zip(t.column(0).to_pylist(), out[:-1], out[1:], strict=True):
                u = np.unique(h[a:b])
                cut = np.searchsorted(u >> np.uint64(60), np.arange(PARTS + 1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([node] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([len(u)] * PARTS, pa.int64()), pa.array([u[c:d].tobytes() for c, d in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["node", "part", "n", "h"])

    @lean
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                x = b.slice(at, 200)
                same = [len(np.intersect1d(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), True)) for s, t in zip(x.column(4), x.column(5), strict=True)]
                yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(same, pa.int64())], ["a", "b", "na", "nb", "same"])

    nodes = links.select(F.col("a").alias("thash")).unionByName(links.select(F.col("b").alias("thash"))).distinct()
    one = texts.join(nodes, "thash", "left_semi").groupBy("thash").agg(F.first("text").alias("text"))
    sets = Saved(one.mapInArrow(run, "node long, part int, n long, h binary")).df
    side = lambda x: sets.select(F.col("node").alias(x), "part", F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}"))
    met = links.join(side("a"), "a").join(side("b"), ["b", "part"]).select("a", "b", "na", "nb", "ha", "hb")
    n = met.mapInArrow(meet, "a long, b long, na long, nb long, same long").groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))
    return n.where(F.col("same") >= similarity * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, shape: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, thash, group): every row's group of near copies; group is the text hash (xxhash64) that stands for it."""
    small_batches(docs.sparkSession)
    shape = shape or shape_for(docs.count(), similarity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("thash", F.xxhash64("text"))
    prints = Saved(_prints(texts, words, shape).groupBy("node").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "uncompressed").df
    groups = components(_close(prints.where(F.length("sketch") > 0), shape))
    roots = components(_verified(groups, prints, texts, words, similarity))
    got = texts.select("doc_id", "thash").join(roots, F.col("thash") == F.col("node"), "left")
    return got.select("doc_id", "thash", F.coalesce("root", "thash").alias("group"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns), one of each group of near copies: the least doc_id's.

    Texts under ``words`` words are one shingle; null and empty texts are copies of each other; a null doc_id comes last,
    rows that share an id go by their text's hash, and of rows equal in both one stays; an empty table gives an empty result.
    """
    with saved_here() as used:
        found = near_groups(docs, words, similarity)
    groups = Saved(found).df
    for x in used:
        x.drop()
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("thash").alias("t"))).alias("x"))
    keep = first.select(F.col("x.n").alias("__n"), F.col("x.i").alias("__i"), F.col("x.t").alias("__t"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    rows = rows.select("row", F.col("d").isNull().alias("n"), F.coalesce("d", F.lit(0)).alias("i"), "t")
    rows = rows.join(keep, (F.col("n") == F.col("__n")) & (F.col("i") == F.col("__i")) & (F.col("t") == F.col("__t")), "left_semi")
    return rows.dropDuplicates(["n", "i", "t"]).select("row.*")
