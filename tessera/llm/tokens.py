"""Token ids of whole texts, exactly those of a public tokenizer file, at the cost of its distinct pieces.

Texts split at blanks, and plain ASCII runs further into letters, digits and signs: the tokenizer treats such pieces
alone, so a piece's ids are found once and then looked up by its 64-bit name. Anything else (apostrophes, bytes above
127, the file's added tokens) stays whole between blanks, as it is, and goes through the tokenizer itself. Only for files whose pre-tokenizer splits at
every blank and drops it, and folds ASCII case (word_bpe_49k.json).
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import Spans

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 4
_CLASS[39] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that are encoded together: the arrays of a step take about 50 times as much.
SLICE = 1 << 20
#: Distinct pieces that a worker remembers; beyond, it starts anew.
REMEMBER = 500_000

_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker: later tasks find what earlier ones learned."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.digits: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.names, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, names: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces under their names, which are sorted and new."""
        ids: list[list[int]] = [[]] * len(pieces)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for i, p in enumerate(pieces):
            c = _CLASS[p[0]]
            if p.isascii() and b"'" not in p and not any(x in p for x in self.added) and (c in (1, 2) or (min(p) > 32 and max(p) < 127)):
                s = p.decode()
                if c == 2:
                    ids[i] = [y for x in s for y in self._digit(x)]
                else:
                    ids[i] = [x.id for x in tokenize(s)]
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        need = sum(map(len, ids))
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        self.flat[self.used : self.used + need] = np.fromiter((y for x in ids for y in x), np.uint32, need)
        at = np.searchsorted(self.names, names)
        self.start = np.insert(self.start, at, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.names = np.insert(self.names, at, names)
        self.used += need

    def _digit(self, x: str) -> list[int]:
        if x not in self.digits:
            self.digits[x] = [y.id for y in self.tokenizer.model.tokenize(x)]
        return self.digits[x]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some documents' UTF-8 bytes, and n + 1 places of the documents in them. One long text is encoded in parts,
        cut at blanks."""
        n = len(data)
        if len(offs) == 2 and n > 2 * SLICE:
            got, a = [], 0
            while a < n:
                b = min(n, a + SLICE)
                while b < n:
                    blank = np.flatnonzero(_CLASS[data[b : b + 4096]] == 0)
                    b = min(n, b + (int(blank[0]) if len(blank) else 4096))
                    if len(blank):
                        break
                got.append(self._encode(data[a:b], np.array([0, b - a]))[0])
                a = b
            return np.concatenate(got), np.array([0, sum(map(len, got))])
        return self._encode(data, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        kind = _CLASS[data]
        word = kind > 0
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        whole = data.tobytes()
        for x in self.added:
            place = whole.find(x)
            while place >= 0:
                kind[place] = 4
                place = whole.find(x, place + 1)
        hard = np.repeat(np.add.reduceat(kind >= 4, at, dtype=np.int32) > 0, np.diff(np.append(at, n)))
        begin = first.copy()
        inner = word[1:].copy()
        inner &= kind[1:] != kind[:-1]
        inner[at[0] :] &= ~hard[1:]
        inner[: at[0]] = False
        begin[1:] |= inner
        end = word.copy()
        end[:-1] &= ~word[1:] | begin[1:]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        low = _LOWER[data]
        low[at[0] :][hard] = data[at[0] :][hard]
        names = Spans(low).of(a, b)
        u, some, inv = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) + len(u) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.names, u)
        new = np.flatnonzero((at == len(self.names)) | (np.append(self.names, np.uint64(0))[at] != u))
        if len(new):
            raw = low.tobytes()
            self._learn(u[new], [raw[x:y] for x, y in zip(a[some[new]].tolist(), b[some[new]].tolist(), strict=True)])
            at = np.searchsorted(self.names, u)
        row = at[inv]
        counts = self.count[row].astype(np.int64)
        out = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.start[row] - out[:-1], counts) + np.arange(out[-1])]
        return ids, out[np.searchsorted(a, offs)]

    def documents(self, data: np.ndarray, offs: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Like encode(), with the id ``last`` after each document."""
        ids, at = self.encode(data, offs)
        if last is None:
            return ids, at
        return np.insert(ids, at[1:], np.uint32(last)), at + np.arange(len(at))
