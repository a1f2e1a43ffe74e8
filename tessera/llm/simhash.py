"""SimHash fingerprints, and their links by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32, fewer than the four that an equality search for three differing
bits needs: of three differing bits, one segment has one at most. Each segment is indexed once for each of its bits with
that bit as a wildcard; two fingerprints that link share such a key. Keys are joined by equality (dealt and sorted), and
whoever shares a key is verified on the whole fingerprint. Inside a key only a spanning forest of the links is emitted:
a crowd of m fingerprints costs m - 1 rows, not m^2, and loses no connection.

Equal fingerprints are one from the start, so exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved, buffers, lean, slices
from tessera.llm.graph import components

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A crowd above this is searched by the bytes of the other segment, one of which is equal for linked fingerprints.
CROWD = 20_000
#: Bytes of one text that are read together; hashes whose bits are unpacked together.
LONG, STEP = 1 << 21, 1 << 16


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of each document, A-Z lower-cased, and each document's range in them. A text beyond
    LONG bytes is read a part at a time, so that work on it takes little more than its hashes."""
    if len(offs) == 2 and len(data) > LONG:
        got = [_hashes(x, np.array([0, len(x)]), words)[0] for x in parts_of(data, words)]
        return np.concatenate(got), np.array([0, sum(map(len, got))])
    return _hashes(data, offs, words)


def parts_of(data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Parts of a text that have its shingles between them: each begins with a word and ends words - 1 words later than
    the next begins."""
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    at = np.flatnonzero(begin)
    del space, begin
    k = 0
    while True:
        to = max(k + 1, int(np.searchsorted(at, (at[k] if len(at) else 0) + LONG)))
        end = to + words - 1
        if end >= len(at):
            yield data[at[k] if len(at) else 0 :]
            return
        yield data[at[k] : at[end]]
        k = to


def document_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, where words begin and end in them, and each document's range of words."""
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    first = first[:-1]
    begin = ~space
    begin[1:] &= space[:-1] | first[1:]
    end = ~space
    end[:-1] &= space[1:] | first[1:]
    word = np.concatenate([[0], np.cumsum(begin)])[offs]
    return _LOWER[data], np.flatnonzero(begin), np.flatnonzero(end) + 1, word


def _hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    low, a, b, word = document_words(data, offs)
    # words with one blank between them, in one string
    size = b - a
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(at[-1], 32, np.uint8)
    text[np.arange(size.sum()) + np.repeat(np.arange(len(a)), size)] = low[np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)]
    text = text.tobytes()
    n = np.diff(word)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    i = np.repeat(word[:-1] - out[:-1], count) + np.arange(out[-1])
    j = i + np.repeat(np.minimum(n, words), count) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(text[s:e], 42) for s, e in zip(at[i].tolist(), (at[j] + size[j]).tolist(), strict=True)], np.uint64), out


def bit_counts(h: np.ndarray, out: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each of the 64 bits; some hashes are unpacked at a time."""
    n = len(out) - 1
    ones = np.zeros((n, 64), np.int64)
    unpacked = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k = 0
    while k < n:
        to = int(np.searchsorted(out, out[k] + STEP, "right")) - 1
        if to <= k:  # one document's
            for a in range(out[k], out[k + 1], STEP):
                ones[k] += unpacked(h[a : min(a + STEP, out[k + 1])]).sum(0, dtype=np.int64)
            k += 1
            continue
        own = k + np.flatnonzero(np.diff(out[k : to + 1]))
        if len(own):
            ones[own] = np.add.reduceat(unpacked(h[out[k] : out[to]]), out[own] - out[k], axis=0, dtype=np.int32)
        k = to
    return ones


def majority(h: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A bit is 1 if over half of the document's hashes have it; no hash: 0."""
    return np.packbits(2 * bit_counts(h, out) > np.diff(out)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(data: np.ndarray, offs: np.ndarray, words: int) -> np.ndarray:
    """The majority of each document's shingle hashes."""
    if not len(offs) - 1:
        return np.zeros(0, np.uint64)
    return majority(*shingle_hashes(data, offs, words))


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text's xxhash64, fp) of docs (doc_id, text)."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(2).combine_chunks(), pa.array(fingerprints(*buffers(t.column(1)), words).view(np.int64))], ["doc_id", "thash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("thash")).mapInArrow(run, "doc_id long, thash long, fp long")


def _forest(x: np.ndarray, most: int, high: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked among unique fingerprints that share a key of one segment."""
    if len(x) == 2:
        return [(x[:1], x[1:])] if int(x[0] ^ x[1]).bit_count() <= most else []
    if len(x) > CROWD:
        out = []
        for byte in range(4):  # of the segment that the key does not hold
            part = (x >> np.uint64(8 * byte + (0 if high else 32))) & np.uint64(255)
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(own) > 1:
                    out += _search(x[own], most)
        return out
    return _search(x, most)


def _search(x: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, rest, todo = [], x, []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        node = todo.pop()
        near = np.bitwise_count(rest ^ node) <= most
        if near.any():
            got = rest[near]
            out.append((np.full(len(got), node), got))
            todo.extend(got)
            rest = rest[~near]
    return out


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly what Hamming distances up to ``most`` (3 at most) connect. distinct: (fp)."""
    if not 0 <= most <= 3:
        raise ValueError("two segments find up to 3 differing bits")
    keys = F.expr("""transform(sequence(0, 63), i -> (cast(i as bigint) << 32) |
        ((IF(i < 32, shiftrightunsigned(fp, 32), fp) & 4294967295L) & ~(1L << (i % 32))))""")
    rows = distinct.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # keys and fingerprints; the last key may go on

        def done(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(k)) + 1
            a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            found = []
            for i in np.flatnonzero(b - a > 1):
                found += _forest(np.unique(x[a[i] : b[i]]), most, int(k[a[i]]) >> 32 < 32)
            sides = [np.concatenate([f[j] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for j in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            n += b.num_rows
            if n < 10_000 or held[0][0][0] == held[-1][0][-1]:
                continue
            k, x = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            at = int(np.searchsorted(k, k[-1]))
            yield done(k[:at], x[:at])
            held, n = [[k[at:], x[at:]]], len(k) - at
        if held:
            yield done(*(np.concatenate([h[j] for h in held]) for j in (0, 1)))

    return rows.mapInArrow(run, "a long, b long").distinct()


def group_fingerprints(fps: DataFrame, most: int = 3) -> DataFrame:
    """(fp, component_id) for each fingerprint of (doc_id, fp): the least doc_id that its links reach (null if none has one)."""
    each = Saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(each.df.select("fp"), most))
    own = each.df.join(roots, each.df.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other; rows with one doc_id each have a row; a null
    doc_id counts as no id when the least is taken; an empty table gives an empty result.
    """
    fps = Saved(with_fingerprints(docs, words)).df
    ids = group_fingerprints(fps, most)
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
