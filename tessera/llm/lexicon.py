"""A lexicon as a minimal acyclic transducer, in one file that workers map into memory.

Words are byte strings. States with the same continuations are one (shared suffixes as well as shared prefixes), and the
outputs along a word's path add up to its number in sorted order, under which its token ids stand. Edges lie in a double
array: the edge of a byte is at ``base[state] + byte`` and is real if ``owner`` names the state there, so one step of many
words is a few array lookups.
"""

from __future__ import annotations

import mmap
from collections.abc import Sequence

import numpy as np

_HEAD = 8


def automaton(words: Sequence[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """Minimal states of sorted distinct words, as (ends a word, ((byte, target), ...)), and the first state. Built word by
    word: what a new word does not share with the last one is final, and is looked up among the states that there are."""
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            ends, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], known.setdefault((ends, tuple(edges)), len(known))))

    for w in words:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        settle(shared)
        path.extend([False, []] for _ in range(len(w) - shared))
        path[-1][0] = True
        last = w
    settle(0)
    first = known.setdefault((path[0][0], tuple(path[0][1])), len(known))
    return list(known), first


def _places(rows: list[list[int]]) -> tuple[np.ndarray, int]:
    """A base for each row of bytes so that no two rows use one slot; rows with many bytes first, each at the first gap it fits."""
    base = np.zeros(len(rows), np.int32)
    free = np.ones(1 << 14, bool)
    low = 0
    for s in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        own = np.array(rows[s])
        if not len(own):
            continue
        at = max(low, int(own[0]))
        while True:
            if at + 4096 + 256 > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            gaps = at + np.flatnonzero(free[at : at + 4096]) - own[0]
            fit = gaps[free[gaps[:, None] + own].all(1)] if len(gaps) else gaps
            if len(fit):
                base[s] = fit[0]
                free[fit[0] + own] = False
                break
            at += 4096
        while not free[low]:
            low += 1
            if low + 1 >= len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
    return base, int(base.max(initial=0)) + 257


def compiled(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file of words and their ids."""
    words = sorted(entries)
    states, first = automaton(words)
    rows = [[x for x, _ in edges] for _, edges in states]
    base, slots = _places(rows)
    owner, target, output = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    size = np.zeros(len(states), np.int64)  # words from a state on; targets are made before what leads to them
    for s, (ends, edges) in enumerate(states):
        n = int(ends)
        for byte, to in edges:
            at = base[s] + byte
            owner[at], target[at], output[at] = s, to, n
            n += int(size[to])
        size[s] = n
    counts = [len(entries[w]) for w in words]
    parts = [base, np.array([e for e, _ in states], np.int32), owner, target, output, np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), np.array([y for w in words for y in entries[w]], np.int32)]
    head = np.array([first, max(map(len, words), default=0), *map(len, parts)], np.int32)
    return b"".join([np.array([len(head)], np.int64).tobytes(), head.tobytes(), *(p.tobytes() for p in parts)])


class Lexicon:
    """The file, mapped: its pages are read as they are needed and shared by all workers of a machine."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(whole, np.int64, 1)[0])
        self.first, self.longest, *sizes = np.frombuffer(whole, np.int32, n, _HEAD).tolist()
        at = _HEAD + 4 * n
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(whole, np.int32, size, at))
            at += 4 * size
        self.base, self.ends, self.owner, self.target, self.output, self.start, self.ids = parts

    def find(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the words data[a:b], -1 where there is none; all words take a step at a time."""
        out = np.full(len(a), -1, np.int32)
        who = np.flatnonzero((b - a <= self.longest) & (b > a)).astype(np.int32)
        at, left = a[who].astype(np.int32), (b - a)[who].astype(np.int32)
        state, number = np.full(len(who), self.first, np.int32), np.zeros(len(who), np.int32)
        while len(who):
            slot = self.base[state] + data[at]
            ok = self.owner[slot] == state
            if not ok.all():
                who, at, left, slot, number = who[ok], at[ok], left[ok], slot[ok], number[ok]
            state = self.target[slot]
            number = number + self.output[slot]
            at, left = at + np.int32(1), left - np.int32(1)
            done = left == 0
            if done.any():
                end = np.flatnonzero(done & (self.ends[state] > 0))
                out[who[end]] = number[end]
                go = ~done
                who, at, left, state, number = who[go], at[go], left[go], state[go], number[go]
        return out
