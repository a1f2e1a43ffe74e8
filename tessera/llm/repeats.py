"""Removal of long repeated byte strings, by bucket-pointer refinement.

A suffix counts only up to its first ``min_bytes`` bytes: two starts are alike when those bytes are equal. As in a
bucket-pointer suffix sort, every start first has the bucket of its short q-gram, and the bucket of a longer prefix follows
from two bucket identifiers, its own and that of a later offset; what one round found is used by the next (1, 2, 4 ... 128
bytes, then 128 and 128 at offset ``min_bytes - 128``). A bucket's identifier is a 64-bit name made from its two parts'
names, not an index into one sorted array, so machines agree on it without a shuffle; where names from all machines meet,
they are sorted, and 32 bits of an independent hash of the whole string tell apart what shares a name by chance. Two
different strings are taken for one with a chance of n^2 / 2^97 for n of them: 10^-5 for all strings of 100 TB.

Only the buckets that can hold more than one start are worth refining, and these are found coarse to fine:

1. Bucket K: the least 32-byte q-gram inside a start's window. Equal windows have equal K. Neighbouring starts with one
   K form a run; a run's whole text has a name U.
2. A run whose U occurs again repeats as a whole. A run needs refining only if its K holds other texts U too, or if
   its K-gram stands more than once in its own text (so that its starts may equal each other); of equal runs, one is
   refined.
3. In those runs each start's bucket is refined to the full ``min_bytes``, and a name that occurs twice is a repeat.

Names are dealt to machines by their own value, BUNDLE packed rows at a time, so that a passage that a third of all
documents share is one entry for each packed row, and messages number bundles times parts, each with many names. A text
beyond LONG bytes is named a window at a time, and only the bytes of chosen runs are named again, so memory stays in
proportion to a few bytes for each byte of the longest text.

Cases: a null text is empty; texts under ``min_bytes`` bytes keep all; equal rows repeat each other; rows with one doc_id
each have a row, a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved, Spans, buffers, pack, partitions_for, release, splitmix, total, unpack

Q = 32
#: Bytes of one text that are named together; packed rows (a power of two of them) whose messages are one; bytes of text
#: whose names meet in one part; bytes of text for each task.
LONG, BUNDLE, PART, TASK = 1 << 21, 32, 24 << 20, 128 << 20
ASK = "r int, bundle long, kind int, body binary"
ASK_ARROW = pa.schema([("r", pa.int32()), ("bundle", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
#: Kinds of messages: names of whole runs; q-gram buckets with the least and greatest run name in them; names of
#: starts; what a bundle knows so far.
RUNS, BUCKETS, STARTS, STATE = 0, 1, 2, 3
#: A name on its way: itself, the hash that backs it, and whether its packed row has it twice.
NAME = np.dtype([("name", "<u8"), ("check", "<u4"), ("twice", "u1")])
SPREAD = np.dtype([("name", "<u8"), ("lo", "<u8"), ("hi", "<u8")])

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BYTE = splitmix(np.arange(256, dtype=np.uint64))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a longer string from the names of two parts."""
    v = a * _M1
    v += b * _M2
    v ^= v >> np.uint64(32)
    v *= _M3
    v ^= v >> np.uint64(29)
    return v


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    h = 1
    while 2 * h <= w:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (w - h)], x[w - h :]) if w > h else x


def _names(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Bucket identifiers by prefix length: each level is made from the one before at a later offset."""
    out, x, h = {}, _BYTE[data], 1
    while h < upto:
        x = _join(x[:-h], x[h:])
        h *= 2
        if h >= Q:
            out[h] = x
    return out


class Runs:
    """The runs of starts of some documents' bytes: first and last start, bucket K, name U and its check, and whether starts of
    the run may equal each other."""

    FIELDS = ("first", "last", "key", "name", "check", "inner")

    def __init__(self, data: np.ndarray, offs: np.ndarray, least: int):
        self.least = least
        self.first = self.last = np.zeros(0, np.int64)
        self.key = self.name = np.zeros(0, np.uint64)
        self.check, self.inner = np.zeros(0, np.uint32), np.zeros(0, bool)
        if len(data) < least:
            return
        if len(offs) == 2 and len(data) > LONG + least:  # a window after the other, each with the starts that begin in it
            parts = []
            for a in range(0, len(data) - least + 1, LONG):
                sub = data[a : a + LONG + least - 1]
                p = Runs(sub, np.array([0, len(sub)]), least)
                p.first, p.last = p.first + a, p.last + a
                parts.append(p)
            for f in self.FIELDS:
                setattr(self, f, np.concatenate([getattr(p, f) for p in parts]))
            return
        with np.errstate(over="ignore"):
            self._find(data, offs)

    def _find(self, data: np.ndarray, offs: np.ndarray) -> None:
        least = self.least
        names = _names(data, 128)
        k = _least(names[Q], least - Q + 1)
        n = len(k)  # starts with a whole window in the buffer
        legal = np.zeros(n + 1, np.int8)
        lo, hi = offs[:-1], offs[1:] - least + 1
        ok = hi > lo
        np.add.at(legal, lo[ok], 1)
        np.add.at(legal, hi[ok], -1)
        legal = np.cumsum(legal[:-1], dtype=np.int8).astype(bool)
        cut = np.zeros(n + 1, bool)
        cut[0] = cut[n] = True
        cut[1:n] = (k[1:] != k[:-1]) | (legal[1:] != legal[:-1])
        cut[lo[ok]] = True  # two documents may meet without a gap
        at = np.flatnonzero(cut)
        long = min(least - Q + 1, 384 - least + 1)  # three names of 128 bytes cover a run's text
        if len(at) > 1 and np.max(np.diff(at)) > long:  # long runs in pieces
            at = np.concatenate([np.append(np.arange(a, b, long), []) for a, b in zip(at[:-1], at[1:], strict=True)] + [at[-1:]]).astype(np.int64)
        a, b = at[:-1], at[1:] - 1
        use = legal[a]
        self.first, self.last, self.key = a[use], b[use], k[a[use]]
        end, big = self.last + least - 128, names[128]
        self.name = _join(_join(big[self.first], big[(self.first + end) >> 1]), _join(big[end], self.key + (self.last - self.first).astype(np.uint64)))
        self.check = (Spans(data).of(self.first, self.last + least) >> np.uint64(32)).astype(np.uint32)
        self.inner = self._periodic(names[Q], k)

    def _periodic(self, gram: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Runs whose K-gram stands at two places of their text: two starts of one run are equal only in these."""
        w = self.least - Q + 1
        edge = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
        at = np.flatnonzero(gram == ~_least(np.concatenate([edge, ~k, edge]), w))  # least of some window
        a, b = np.searchsorted(at, self.first), np.searchsorted(at, self.last + w)
        n = b - a
        run = np.repeat(np.arange(len(n)), n)
        place = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        return np.bincount(run[gram[place] == self.key[run]], minlength=len(n)) > 1


def _starts(data: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, name, check) of the windows that begin in some runs. Only the runs' bytes are named, LONG of them at a time."""
    size = last - first + least
    upto = np.cumsum(size)
    k = 0
    while k < len(first):
        to = max(k + 1, int(np.searchsorted(upto, upto[k] - size[k] + LONG, "right")))
        f, n = first[k:to], last[k:to] - first[k:to] + 1
        at = np.concatenate([[0], np.cumsum(size[k:to])[:-1]])
        take = np.repeat(f - at, size[k:to]) + np.arange(size[k:to].sum())
        own = data[take]
        with np.errstate(over="ignore"):
            big = _names(own, 128)[128]
            pos = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            name = _join(big[pos], big[pos + least - 128])
        yield take[pos], name, (Spans(own).of(pos, pos + least) >> np.uint64(32)).astype(np.uint32)
        k = to


def _deal(parts: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order that puts names of one part together, each part's end in it)."""
    to = ((names >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    return np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=parts))


class _Out:
    """Messages of one kind to all parts, packed row after packed row."""

    def __init__(self, parts: int):
        self.to: list[list[bytes]] = [[] for _ in range(parts)]

    def add(self, rows: np.ndarray) -> None:
        order, ends = _deal(len(self.to), rows["name"])
        rows = rows[order]
        a = 0
        for part, b in enumerate(ends.tolist()):
            if b > a:
                self.to[part].append(rows[a:b].tobytes())
            a = b

    def messages(self, bundle: int, kind: int) -> list[tuple]:
        return [(part, bundle, kind, b"".join(x)) for part, x in enumerate(self.to) if x]


class _In:
    """The parts' answers to _Out's messages, to be taken in the same order."""

    def __init__(self, t: pa.Table, kind: int, parts: int):
        self.bits: dict[int, np.ndarray] = {}
        for r, k, body in zip(t.column("r").to_pylist(), t.column("kind").to_pylist(), t.column("body"), strict=True):
            if k == kind:
                bits = np.unpackbits(np.frombuffer(body.as_buffer(), np.uint8))
                self.bits[r] = (2 * bits[0::2] + bits[1::2]).astype(np.uint8)
        self.at = [0] * parts

    def take(self, names: np.ndarray) -> np.ndarray:
        """Flags for the names of the next packed row."""
        order, ends = _deal(len(self.at), names)
        out = np.zeros(len(names), np.uint8)
        a = 0
        for part, b in enumerate(ends.tolist()):
            if b > a:
                n = b - a
                out[order[a:b]] = self.bits[part][self.at[part] : self.at[part] + n]
                self.at[part] += n
            a = b
        return out


def _unique(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of one packed row in order, each once, as messages; and each one's place in them."""
    u, first, inv, n = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    out = np.zeros(len(u), NAME)
    out["name"], out["check"], out["twice"] = u, checks[first], n > 1
    return out, inv


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(ASK_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in ASK_ARROW.names}, schema=ASK_ARROW)


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of names from many packed rows: each one's bucket, the first member of each bucket, and how many it has. Names are sorted;
    a bucket whose members' checks differ is taken apart by them."""
    _, first, inv, n = np.unique(x["name"], return_index=True, return_inverse=True, return_counts=True)
    if (x["check"] != x["check"][first][inv]).any():
        both = np.empty(len(x), [("name", "<u8"), ("check", "<u4")])
        both["name"], both["check"] = x["name"], x["check"]
        _, first, inv, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return inv, first, n


def _answer(t: pa.Table) -> pa.Table:
    """One part's messages: sort the names, and tell each bundle what its names meet elsewhere."""
    out = []
    kinds = np.array(t.column("kind").to_pylist(), np.int64)
    bundles = np.array(t.column("bundle").to_pylist(), np.int64)
    r = t.column("r")[0].as_py()
    body = t.column("body")
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(bundles[rows], kind="stable")]
        if kind == STATE:  # on its way to its bundle
            out += [(r, int(bundles[i]), STATE, body[int(i)].as_py()) for i in rows]
            continue
        got = [np.frombuffer(body[int(i)].as_buffer(), SPREAD if kind == BUCKETS else NAME) for i in rows]
        x = np.concatenate(got)
        if kind == BUCKETS:
            k, inv = np.unique(x["name"], return_inverse=True)
            lo, hi = np.full(len(k), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(k), np.uint64)
            np.minimum.at(lo, inv, x["lo"])
            np.maximum.at(hi, inv, x["hi"])
            flags = (lo != hi)[inv].astype(np.uint8)
        else:
            inv, first, n = _same(x)
            again = n > 1
            np.logical_or.at(again, inv, x["twice"] > 0)
            mine = first[inv] == np.arange(len(x))  # of equal runs, the first packed row's is refined
            flags = (again[inv] + 2 * mine).astype(np.uint8)
        at = 0
        for i, own in zip(rows, got, strict=True):
            bits = np.unpackbits(flags[at : at + len(own), None], axis=1)[:, -2:]
            out.append((r, int(bundles[i]), kind, np.packbits(bits).tobytes()))
            at += len(own)
    release()
    return _rows(out)


def _text(t: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray]:
    return buffers(t.column(at))


def _in_order(t: pa.Table) -> Iterator[pa.Table]:
    """The packed rows of a bundle, always in one order."""
    for i in np.argsort(t.column("batch").to_numpy(), kind="stable"):
        yield unpack(t.column("body")[int(i)].as_py())


def _covered(n: int, starts: tuple[np.ndarray, np.ndarray], more: np.ndarray, least: int) -> np.ndarray:
    """Which of n bytes lie in a window that begins in pieces of starts or at single ones."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts[0], 1)
    np.add.at(d, starts[1] - 1 + least, -1)
    np.add.at(d, more, 1)
    np.add.at(d, more + least, -1)
    return np.cumsum(d[:-1], dtype=np.int32) > 0


def _whole(data: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Like cov, but no UTF-8 character loses only some of its bytes."""
    tail = (data & 0xC0) == 0x80
    if not tail.any():
        return cov
    char = np.cumsum(~tail) - 1  # a document's first byte is never a tail
    kept = np.zeros(int(char[-1]) + 1, bool)
    kept[char[~cov]] = True
    return ~kept[char]


def _spans(cov: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed pieces of each document."""
    rise = cov.copy()
    rise[1:] &= ~cov[:-1]
    inner = offs[:-1][offs[:-1] < len(cov)]
    rise[inner] = cov[inner]
    a, b = (np.concatenate([[0], np.cumsum(x)]) for x in (cov, rise))
    return a[offs[1:]] - a[offs[:-1]], b[offs[1:]] - b[offs[:-1]]


def _refine(docs: DataFrame, text: str, least: int) -> tuple[DataFrame, DataFrame, int]:
    if not 128 + Q <= least <= 256:
        raise ValueError(f"min_bytes must be from {128 + Q} to 256")
    at = docs.columns.index(text)
    packed = pack(docs, text).df
    size = total(packed, "n_bytes")
    parts = partitions_for(size, PART)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    dealt = lambda df, by: df.repartition(tasks, by).groupBy(by)
    packed = packed.select(F.expr(f"batch div {BUNDLE}").alias("bundle"), "batch", "body")

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        runs_out, buckets_out = _Out(parts), _Out(parts)
        for doc in _in_order(t):
            runs = Runs(*_text(doc, at), least)
            runs_out.add(_unique(runs.name, runs.check)[0])
            k, inv = np.unique(runs.key, return_inverse=True)
            x = np.zeros(len(k), SPREAD)
            x["name"], x["lo"] = k, np.iinfo(np.uint64).max
            np.minimum.at(x["lo"], inv, runs.name)
            np.maximum.at(x["hi"], inv, runs.name)
            buckets_out.add(x)
        release()
        return _rows(runs_out.messages(key[0].as_py(), RUNS) + buckets_out.messages(key[0].as_py(), BUCKETS))

    def refine(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        runs_in, buckets_in, out, states = _In(right, RUNS, parts), _In(right, BUCKETS, parts), _Out(parts), []
        for doc in _in_order(left):
            data, offs = _text(doc, at)
            runs = Runs(data, offs, least)
            u, inv = _unique(runs.name, runs.check)
            flags = runs_in.take(u["name"])
            again = (flags & 1).astype(bool)[inv]
            here = np.zeros(len(inv), bool)
            here[np.unique(inv, return_index=True)[1]] = True  # one run of each name in this packed row
            chosen = (flags & 2).astype(bool)[inv] & here
            k, kinv = np.unique(runs.key, return_inverse=True)
            many = (buckets_in.take(k) & 1).astype(bool)[kinv]
            which = np.flatnonzero((many | runs.inner) & chosen)
            got = list(_starts(data, runs.first[which], runs.last[which], least))
            if got:
                out.add(_unique(np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))[0])
            fresh = ~again[which]  # the others repeat anyway
            state = [runs.first[again], runs.last[again], runs.first[which], runs.last[which], fresh]
            states += [np.array([len(x) for x in state], np.int32).tobytes(), *[x.astype(np.int32).tobytes() for x in state]]
        release()
        bundle = key[0].as_py()
        return _rows([*out.messages(bundle, STARTS), (parts + bundle % parts, bundle, STATE, b"".join(states))] if left.num_rows else [])

    answers = dealt(dealt(packed, "bundle").applyInArrow(ask, ASK), "r").applyInArrow(_answer, ASK)
    asked = dealt(packed, "bundle").cogroup(dealt(answers, "bundle")).applyInArrow(refine, ASK)
    told = dealt(asked, "r").applyInArrow(_answer, ASK)
    return dealt(packed, "bundle"), dealt(told, "bundle"), parts


def _finish(packed, told, parts: int, at: int, least: int, schema: str, build) -> DataFrame:
    """build(table, data, offsets, covered bytes) makes the result of a packed row."""

    def end(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        starts_in, out, place = _In(right, STARTS, parts), [], 0
        kinds = right.column("kind").to_pylist()
        states = right.column("body")[kinds.index(STATE)].as_py()
        for t in _in_order(left):
            data, offs = _text(t, at)
            sizes = np.frombuffer(states, np.int32, 5, place)
            a, b, c, d, fresh = np.split(np.frombuffer(states, np.int32, int(sizes.sum()), place + 20).astype(np.int64), np.cumsum(sizes)[:-1])
            place += 20 + 4 * int(sizes.sum())
            more = c[:0]
            if len(c):
                got = list(_starts(data, c, d, least))
                pos, names = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                u, inv = np.unique(names, return_inverse=True)
                more = pos[(starts_in.take(u) & 1).astype(bool)[inv] & np.repeat(fresh > 0, d - c + 1)]
            out.append(build(t, data, offs, _covered(len(data), (a, b + 1), more, least)))
        release()
        return pa.concat_tables(out)

    return packed.cogroup(told).applyInArrow(end, schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def measure_repeats(docs: DataFrame, min_bytes: int = 200) -> DataFrame:
    """For each document: its bytes, those removed, removed pieces, and the SHA-256 of what is left."""
    packed, told, parts = _refine(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", min_bytes)

    def build(t: pa.Table, data: np.ndarray, offs: np.ndarray, cov: np.ndarray) -> pa.Table:
        gone, spans = _spans(cov, offs)
        left = [hashlib.sha256((data[a:b][~cov[a:b]] if g else data[a:b]).tobytes()).hexdigest() for a, b, g in zip(offs[:-1], offs[1:], gone, strict=True)]
        return pa.table({"doc_id": t.column(0), "n_bytes": np.diff(offs), "n_removed": gone, "n_spans": spans, "kept_sha256": left}).cast(pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return _finish(packed, told, parts, 1, min_bytes, DIGEST, build)


def strip_repeats(docs: DataFrame, text: str = "text", min_bytes: int = 200, count: str | None = "n_chars") -> DataFrame:
    """``docs`` without their repeated strings. A character that would lose some of its bytes stays whole; null stays null.

    ``count`` names the column with the text's length in characters, which follows; None or absent: no such column.
    """
    packed, told, parts = _refine(docs, text, min_bytes)
    at, names = docs.columns.index(text), docs.columns
    counted = names.index(count) if count in names else None

    def build(t: pa.Table, data: np.ndarray, offs: np.ndarray, cov: np.ndarray) -> pa.Table:
        cov = _whole(data, cov) if len(data) else cov
        gone, _ = _spans(cov, offs)
        hit = np.flatnonzero(gone)
        if not len(hit):
            return t
        old = t.column(at).to_pylist()
        sizes = t.column(counted).to_pylist() if counted is not None else None
        for i in hit:
            a, b = offs[i], offs[i + 1]
            old[i] = data[a:b][~cov[a:b]].tobytes().decode()
            if sizes is not None:
                sizes[i] = len(old[i])
        t = t.set_column(at, t.schema.field(at), pa.chunked_array([pa.array(old, t.schema.field(at).type)]))
        return t.set_column(counted, t.schema.field(counted), pa.chunked_array([pa.array(sizes, t.schema.field(counted).type)])) if sizes is not None else t

    return _finish(packed, told, parts, at, min_bytes, docs.schema, build)
