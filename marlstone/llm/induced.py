"""External induced suffix sorting with common-prefix values.

Suffixes are sorted by induction from the S* suffixes (an ascending suffix after a descending one). The priority queue is a
queue per first symbol, which holds (position, common prefix with the entry before) in the order in which they leave it;
what a queue holds beyond MEMORY goes to a file. One pass up the symbols induces the descending suffixes, one down the
ascending ones; common prefixes follow from those of the sources: one more than their smallest between two sources of the
same queue, 1 between sources of different symbols, and the shorter run of equal symbols where both kinds meet.

The S* suffixes are sorted by recursion: one induction sorts the substrings between them, which get names in order; the
suffixes of the string of names are sorted in turn, by doubling, as its alphabet is as large as itself.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Common prefixes are counted so far at least, and up to LONGEST where longer ones are wanted (they are held in 16 bits).
CAP, LONGEST = 1 << 12, (1 << 15) - 64
#: What queues hold in memory; the rest of them is in a file of the task. Less than a shard of suffix_dedup needs.
MEMORY = 1 << 20


class Queue:
    """Batches of (positions, common prefixes), first in, first out, on disk beyond MEMORY bytes."""

    def __init__(self, store: Store):
        self.store, self.batches = store, []

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.batches.append(self.store.keep(pos, lcp))

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        got = [self.store.fetch(x) for x in self.batches]
        self.batches = []
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        pos, lcp = (np.concatenate(x) for x in zip(*got))
        lcp[0] = 0
        return pos, lcp


class Store:
    """Memory that all queues share, and the file for the rest."""

    def __init__(self, memory: int | None = None):
        self.left, self.file = MEMORY if memory is None else memory, None

    def keep(self, pos: np.ndarray, lcp: np.ndarray):
        if (size := pos.nbytes + lcp.nbytes) <= self.left:
            self.left -= size
            return pos, lcp
        if self.file is None:
            fd, name = tempfile.mkstemp(prefix="queue-")
            self.file = os.fdopen(fd, "r+b")
            os.unlink(name)  # goes with the process
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(pos.tobytes() + lcp.tobytes())
        return at, len(pos)

    def fetch(self, kept) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(kept[0], np.ndarray):
            self.left += kept[0].nbytes + kept[1].nbytes
            return kept
        at, n = kept
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(2 * n), np.int16)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _between(lcp: np.ndarray, at: np.ndarray, first: int, cap: int) -> np.ndarray:
    """Common prefixes of what is induced from the entries `at` of one queue; `first` for the first of them."""
    out = np.empty(len(at), np.int16)
    out[0] = first
    if len(at) > 1:
        out[1:] = np.minimum(np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) + 1, cap)
    return out


def _waves(t: np.ndarray, cap: int, c: int, pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of one kind that begin with c: those that other symbols induced, then those that these induce, and so on."""
    seq, prefix = [pos], [lcp]
    last, turn = 0, 0
    while len(pos):
        at = np.flatnonzero((pos > 0) & (t[pos - 1] == c))
        if not len(at):
            break
        first = 1 if not turn else min(int(prefix[-2][last + 1 :].min(initial=cap)), int(lcp[: at[0] + 1].min())) + 1
        pos, lcp, last = pos[at] - np.int32(1), _between(lcp, at, min(first, cap), cap), int(at[-1])
        seq.append(pos)
        prefix.append(lcp)
        turn += 1
    return np.concatenate(seq), np.concatenate(prefix)


def _deal(t: np.ndarray, cap: int, pos: np.ndarray, lcp: np.ndarray, queues: list[Queue], wanted) -> None:
    """Push the predecessors of these entries whose symbol is wanted to the queues of their symbols."""
    at = np.flatnonzero(pos > 0)
    symbol = t[pos[at] - 1]
    ok = wanted(symbol)
    at, symbol = at[ok], symbol[ok]
    if not len(at):
        return
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    cuts = np.flatnonzero(np.diff(symbol)) + 1
    for group, d in zip(np.split(at[order], cuts), symbol[np.concatenate([[0], cuts])].tolist()):
        queues[d].push(pos[group] - np.int32(1), _between(lcp, group, 1, cap))


def induce(t: np.ndarray, cap: int, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes, from the S* suffixes in order."""
    n, store = len(t), Store()
    queues = [Queue(store) for _ in range(256)]
    queues[t[n - 1]].push(np.array([n - 1], np.int32), np.zeros(1, np.int16))
    cuts = np.searchsorted(t[seeds], np.arange(257)) if len(seeds) else np.zeros(257, np.int64)
    down = []
    meet = lambda a, b: min(int(run[a]), int(run[b]), cap)
    for c in range(256):
        pos, lcp = _waves(t, cap, c, *queues[c].drain())
        down.append((pos, lcp))
        s, p = seeds[cuts[c] : cuts[c + 1]], seed_lcp[cuts[c] : cuts[c + 1]].copy()
        if len(s):
            p[0] = meet(pos[-1], s[0]) if len(pos) else 0
        _deal(t, cap, np.concatenate([pos, s]), np.concatenate([lcp, p]), queues, lambda x: x > c)  # noqa: B023
    parts: list = [None] * 256
    for c in reversed(range(256)):
        pos, lcp = _waves(t, cap, c, *queues[c].drain())  # in descending order
        low, low_lcp = down[c]
        border = meet(low[-1], pos[-1]) if len(low) and len(pos) else 0
        up_lcp = np.concatenate([[border], lcp[:0:-1]]).astype(np.int16) if len(pos) else lcp
        parts[c] = (np.concatenate([low, pos[::-1]]), np.concatenate([low_lcp, up_lcp]))
        down[c] = None
        back = np.concatenate([[border], low_lcp[:0:-1]]).astype(np.int16) if len(low) else low_lcp
        _deal(t, cap, np.concatenate([pos, low[::-1]]), np.concatenate([lcp, back]), queues, lambda x: x < c)  # noqa: B023
    store.close()
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names (0, 1, ...)."""
    rank, n, k = names.astype(np.int64), len(names), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, `most` at most, eight symbols at a time."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 0
    while len(live):
        x = words[a[live] + step] ^ words[b[live] + step]
        same = x == 0
        ended = live[~same]
        low = x[~same]
        out[ended] = step + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        live, step = live[same], step + 8
        out[live] = step
        live = live[most[live] > step]
    return np.minimum(out, most)


def suffix_array(t: np.ndarray, wanted: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of symbols 0..255 and each suffix's common prefix with the one before, counted
    up to CAP or `wanted` (LONGEST at most), whichever is more."""
    if wanted > LONGEST:
        raise ValueError(f"common prefixes are counted up to {LONGEST} only")
    n, cap = len(t), max(CAP, wanted + 8)
    if n < 2:
        return np.arange(n, dtype=np.int32), np.zeros(n, np.int16)
    edge = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run
    length = np.diff(edge, prepend=-1)
    run = np.repeat(edge, length) - np.arange(n) + 1
    ascending = np.repeat(np.append(t[edge[:-1] + 1] > t[edge[:-1]], False), length)
    star = (np.flatnonzero(ascending[1:] & ~ascending[:-1]) + 1).astype(np.int32)
    run = np.minimum(run, cap).astype(np.int16)
    if not len(star):
        return induce(t, cap, run, star, np.zeros(0, np.int16))
    padded = np.zeros(n + cap + 16, np.uint8)
    padded[:n] = t
    words = np.ndarray(n + cap + 8, "<u8", padded, strides=(1,))  # the eight symbols from each place on, without a copy
    rough = star[np.argsort(t[star], kind="stable")]
    order, _ = induce(t, cap, run, rough, np.zeros(len(rough), np.int16))
    is_star = np.zeros(n, bool)
    is_star[star] = True
    order = order[is_star[order]]
    size = np.zeros(n, np.int64)
    size[star] = np.append(np.diff(star) + 1, n + 1)
    a, b = order[:-1], order[1:]
    limit = np.where(size[a] == size[b], size[a], 0)
    equal = np.zeros(len(a), bool)
    some = np.flatnonzero(limit > 0)
    some = some[limit[some] <= n]
    equal[some] = _equal(words, a[some], b[some], limit[some])
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~equal)])
    names = names[star]
    ranked = star[_doubling(names)] if names.max() < len(names) - 1 else order
    lcp = np.zeros(len(ranked), np.int16)
    lcp[1:] = common_prefix(words, ranked[:-1], ranked[1:], np.minimum(np.minimum(n - ranked[:-1], n - ranked[1:]), cap - 8))
    return induce(t, cap, run, ranked, lcp)


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` symbols at a and at b are equal."""
    ok = np.ones(len(a), bool)
    live, step, most = np.arange(len(a)), 0, len(words) - 1
    while len(live):
        left = np.minimum(size[live] - step, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        bad = (words[np.minimum(a[live] + step, most)] ^ words[np.minimum(b[live] + step, most)]) & mask != 0
        ok[live[bad]] = False
        step += 8
        live = live[~bad]
        live = live[size[live] > step]
    return ok
