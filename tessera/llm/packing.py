"""Packing token sequences: bounded-space online packing, and best-fit-decreasing packing into id matrices."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved, buffers, lean, slices
from tessera.llm.tokens import SLICE, encoder

PIECE = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
_ROUND = [*PIECE, ("part", "long"), ("open", "boolean")]
_DDL = ", ".join(f"`{n}` {t}" for n, t in _ROUND)
_ARROW = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in _ROUND])

#: Open windows of each partition; partitions whose leftovers are merged together; leftover windows that go on to the
#: next merge.
WINDOWS, FAN, CARRY = 16, 64, 2
#: A document is cut to fill the fullest window, unless the gap is shorter than this.
CUT = 32


class Windows:
    """A fixed number of open windows, best fit first."""

    def __init__(self, size: int, most: int, ids: Iterator[int]):
        self.size, self.most, self.ids = size, most, ids
        self.gaps: list[tuple[int, int]] = []  # sorted (free, sequence_id)
        self.held: dict[int, list[tuple]] = {}
        self.full: list[tuple] = []

    def _put(self, at: int, piece: tuple, n: int) -> None:
        free, seq = self.gaps.pop(at)
        rows = self.held[seq]
        rows.append((*piece, seq, self.size - free))
        if free > n:
            insort(self.gaps, (free - n, seq))
        else:
            self._close(seq)

    def _close(self, seq: int) -> None:
        self.full += self.held.pop(seq)

    def _new(self) -> None:
        seq = next(self.ids)
        insort(self.gaps, (self.size, seq))
        self.held[seq] = []

    def add(self, n: int, piece) -> None:
        """piece(start, length) makes the row of a document's part; n: its length."""
        start = 0
        while n - start >= self.size:
            seq = next(self.ids)
            self.full.append((*piece(start, self.size), seq, 0))
            start += self.size
        while n > start:
            rest = n - start
            at = bisect_left(self.gaps, (rest, -1))
            if at == len(self.gaps):
                if len(self.gaps) < self.most:
                    self._new()
                    continue
                free, seq = self.gaps[0]
                if free >= CUT:  # a part of the document fills the fullest window, which is then emitted
                    self._put(0, piece(start, free), free)
                    start += free
                else:
                    self.gaps.pop(0)
                    self._close(seq)
                continue
            self._put(at, piece(start, rest), rest)
            start = n

    def take(self) -> list[tuple]:
        out, self.full = self.full, []
        return out


def _table(rows: list[tuple], part: int, is_open: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([part] * len(rows), pa.int64()), pa.array([is_open] * len(rows), pa.bool_())], schema=_ARROW)


def _count(start: int) -> Iterator[int]:
    while True:
        yield start
        start += 1


def _merge(t: pa.Table, key: int, size: int, level: int, last: bool) -> pa.Table:
    """Pack leftover pieces again, longest first and uncut; all but the emptiest windows are done, or all at last."""
    t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("sequence_id", "ascending")])
    gaps: list[tuple[int, int]] = []
    used: dict[int, int] = {}
    ids = _count(level << 56 | key << 32)
    seqs, offs = [], []
    for n in t.column("length").to_pylist():
        at = bisect_left(gaps, (n, -1))
        free, seq = gaps.pop(at) if at < len(gaps) else (size, next(ids))
        seqs.append(seq)
        offs.append(size - free)
        used[seq] = size - free + n
        if free > n:
            insort(gaps, (free - n, seq))
    carry = set() if last else set(sorted(used, key=lambda s: (used[s], s))[:CARRY])
    now = {"sequence_id": pa.array(seqs, pa.int64()), "offset": pa.array(offs, pa.int64()), "part": pa.array([key] * len(seqs), pa.int64()), "open": pa.array([s in carry for s in seqs], pa.bool_())}
    return pa.Table.from_arrays([now.get(n, t.column(n)) for n in _ARROW.names], schema=_ARROW)


def _merger(size: int, level: int, last: bool):
    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return _merge(t, key[0].as_py(), size, level, last)

    return merge


def pack_online(docs: DataFrame, path: str, size: int = 4096, last_id: int | None = 2, windows: int = WINDOWS) -> DataFrame:
    """Pieces of all documents (doc_id, text), packed into sequences of at most ``size`` tokens.

    Bounded-space online packing: each partition keeps ``windows`` open windows. A document goes to the window where it
    leaves the least room; where none fits, the fullest is filled with the document's first part (unless that is under
    CUT tokens) and emitted. Windows still open at a partition's end are merged, FAN partitions at a time, by best fit
    of their uncut pieces; the emptiest CARRY of each merge go on to the next.

    Null and empty texts have the id ``last_id`` alone; without it they have no piece. Documents of any length are cut
    losslessly; rows with one doc_id are each a document, a null doc_id stays null; an empty table gives an empty result.
    """
    if size < 2 or windows < 1:
        raise ValueError("size and windows must be positive")

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        w = Windows(size, windows, _count(part << 32))
        enc = encoder(path)
        for t in slices(batches, 1, SLICE):
            ids, at = enc.documents(*buffers(t.column(1)), last_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            for doc, a, b in zip(t.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):

                def piece(start: int, n: int, doc=doc, a=a, b=b) -> tuple:
                    return doc, start, n, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + n)]), b - a

                w.add(b - a, piece)
            yield _table(w.take(), part, False)
        yield _table([x for rows in w.held.values() for x in rows], part, True)

    now = Saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DDL)).df
    done, level = [now.where("not open")], 0
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level += 1
        parts = -(-parts // FAN)
        group = now.where("open").withColumn("part", F.expr(f"part div {FAN}"))
        now = Saved(group.groupBy("part").applyInArrow(_merger(size, level, parts == 1), _DDL)).df
        done.append(now.where("not open"))
        if parts == 1:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*[n for n, _ in PIECE])


class Capacities:
    """A segment tree over free room 0..size: the least room that is enough, in log(size) steps."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        i = room + self.width
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``need``, and its room; it is out of the tree then."""
        i = need + self.width
        some = self.some
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.width
        which = self.bins[room].pop()
        if not self.bins[room]:
            some[i] = 0
            i >>= 1
            while i and not (some[2 * i] or some[2 * i + 1]):
                some[i] = 0
                i >>= 1
        return which, room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length (all at most ``size``) and its offset there."""
    tree, rooms = Capacities(size), 0
    bins, offs = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            got = rooms, size
            rooms += 1
        bins[i], offs[i] = got[0], size - got[1]
        if got[1] > n:
            tree.add(got[1] - n, got[0])
    return bins, offs


MATRIX = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_ids binary, input_ids binary"
_MATRIX = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("input_ids", pa.binary())])
#: Tokens that are packed together: room enough that the last sequence's padding is small.
CHUNK = 1_000_000


def pack_matrix(docs: DataFrame, path: str, size: int = 4096, last_id: int | None = 2, pad_id: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows of a packed id matrix out of docs (doc_id, text): best-fit-decreasing, by a segment tree over free room.

    A document longer than ``size`` is split into pieces of ``size`` and one rest, without loss. Each row holds ``size``
    little-endian 32-bit ids (``input_ids``, padded with pad_id), the pieces' cumulative lengths (``cu_seqlens``), their
    documents and starts, and positions that begin anew at each piece (``position_ids``, little-endian 32-bit).
    Tokens are packed ``chunk`` at a time, so memory does not grow with a partition. Null and empty texts have last_id
    alone (without it: no piece); rows with one doc_id are each a document, a null doc_id stays null; an empty table
    gives an empty result.
    """

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seqs = TaskContext.get().partitionId() << 32, 0
        enc = encoder(path)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        n_held = 0

        def packed() -> pa.RecordBatch:
            nonlocal seqs, held, n_held
            ids = np.concatenate([h[0] for h in held])
            n = np.concatenate([np.diff(h[1]) for h in held])
            at = np.concatenate([[0], np.cumsum(n)])
            docs_ = [d for h in held for d in h[2]]
            cuts = -(-n // size)
            doc = np.repeat(np.arange(len(n)), cuts)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = k * size
            length = np.minimum(n[doc] - start, size)
            bins, offs = best_fit_decreasing(length, size)
            order = np.lexsort((offs, bins))
            groups = np.split(order, np.flatnonzero(np.diff(bins[order])) + 1) if len(order) else []
            rows: dict[str, list] = {f: [] for f in _MATRIX.names}
            for g in groups:
                cu = np.concatenate([[0], np.cumsum(length[g])]).astype(np.int32)
                row, pos = np.full(size, pad_id, "<u4"), np.zeros(size, "<u4")
                for i, a, b in zip(g.tolist(), cu[:-1].tolist(), cu[1:].tolist(), strict=True):
                    s = at[doc[i]] + start[i]
                    row[a:b] = ids[s : s + b - a]
                    pos[a:b] = np.arange(b - a)
                for f, x in zip(_MATRIX.names, (base + seqs, int(cu[-1]), [docs_[doc[i]] for i in g], start[g].tolist(), cu.tolist(), pos.tobytes(), row.tobytes()), strict=True):
                    rows[f].append(x)
                seqs += 1
            held, n_held = [], 0
            return pa.RecordBatch.from_pydict(rows, schema=_MATRIX)

        for t in slices(batches, 1, SLICE):
            ids, at = enc.documents(*buffers(t.column(1)), last_id)
            held.append((ids, at, t.column(0).to_pylist()))
            n_held += len(ids)
            if n_held >= chunk:
                yield packed()
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATRIX)


def write_packed(rows: DataFrame, path: str) -> None:
    """The matrix as Parquet files, which readers can map by row."""
    rows.write.mode("overwrite").parquet(path)


def unpack_matrix(frame: pd.DataFrame) -> dict[int, list[int]]:
    """Ids by document out of a packed matrix's rows: the round trip, for tests and small samples."""
    parts: dict[int, list[tuple[int, list[int]]]] = {}
    for r in frame.itertuples():
        ids = np.frombuffer(r.input_ids, "<u4")
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts.setdefault(int(d), []).append((int(s), ids[a:b].tolist()))
    return {d: [x for _, p in sorted(v) for x in p] for d, v in parts.items()}
