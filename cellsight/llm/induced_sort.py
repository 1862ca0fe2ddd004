"""Suffix sorting by induction with common-prefix values, on disk-backed queues.

`repeated_positions` finds the positions of a text whose suffix shares at least `length` symbols with a
neighbour in suffix order.  The text stays in memory (one byte a symbol); the tuples (position, common
prefix with the previous suffix), which are nine times as large, pass through queues that spill to files
beyond a bound.

1. The left-most S suffixes (S*) are cut into substrings that get names in their order.  If names repeat,
   the string of names is sorted recursively by the same induction; a string of names that fits the bound
   is sorted by prefix doubling.
2. Scanning all suffixes from the least on, each L suffix is pushed into the queue of its first symbol by
   the suffix after it.  Pushes come in the order of the result, so a queue per symbol is a monotone
   priority queue.  The common prefix of two successive pushes is one more than the least value between
   their sources.
3. Scanning from the largest down, S suffixes are pushed in the same way.

Common prefixes are kept up to `length`, and so is the order: suffixes equal in their first `length` symbols
may come in any order, which keeps such suffixes next to each other.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 16


class Store:
    """Blocks of (positions, prefixes) of many queues, with a common bound on the bytes held in memory."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.queues: list[Queue] = []
        self.folder: str | None = None

    def spill(self) -> None:
        """Write all blocks to the task's own temporary folder, which is removed when the sort ends."""
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-")
        for q in self.queues:
            q.to_disk()
        self.held = 0

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Queue:
    """A list of blocks, read from the front (and dropped) or from the back.

    A block is its two arrays, or where they lie in the queue's file, or None when it has been read.
    """

    def __init__(self, store: Store):
        self.store, self.blocks, self.at = store, [], 0
        store.queues.append(self)

    def push(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks.append((positions, prefixes))
        self.store.held += positions.nbytes + prefixes.nbytes
        if self.store.held > self.store.memory:
            self.store.spill()

    def _path(self) -> str:
        return os.path.join(self.store.folder, str(id(self)))

    def to_disk(self) -> None:
        held = [k for k in range(self.at, len(self.blocks)) if len(self.blocks[k]) == 2]
        if held:
            with open(self._path(), "ab") as f:
                for k in held:
                    positions, prefixes = self.blocks[k]
                    self.blocks[k] = (f.tell(), len(positions), positions.dtype)
                    f.write(positions.tobytes())
                    f.write(prefixes.tobytes())

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        block = self.blocks[k]
        if len(block) == 2:
            return block
        start, n, dtype = block
        with open(self._path(), "rb") as f:
            f.seek(start)
            return np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype), np.frombuffer(f.read(n), dtype=np.uint8)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From the front, with what is pushed meanwhile; the small blocks that lie ready are joined."""
        while self.at < len(self.blocks):
            taken, size = [], 0
            while self.at < len(self.blocks) and size < _BLOCK:
                block = self._block(self.at)
                if len(self.blocks[self.at]) == 2:
                    self.store.held -= block[0].nbytes + block[1].nbytes
                self.blocks[self.at] = None
                taken.append(block)
                size += len(block[0])
                self.at += 1
            yield np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken])

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(len(self.blocks) - 1, -1, -1):
            positions, prefixes = self._block(k)
            yield positions[::-1], prefixes[::-1]


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for ranges that are not empty."""
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, current = np.empty(len(low), dtype=values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            current = np.minimum(current[:-half], current[half:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(current[low[mine]], current[high[mine] - (1 << k) + 1])
    return out


class _Induction:
    """One scan: takes blocks of sorted suffixes and pushes the suffixes before them."""

    def __init__(self, text: np.ndarray, store: Store, symbols: int, length: int):
        self.text, self.length = text, length
        self.queues: dict[int, Queue] = {}
        self.store = store
        self.since = np.full(symbols, 255, dtype=np.uint8)  # least prefix since a symbol's last push
        self.begun = np.zeros(symbols, dtype=bool)

    def queue(self, symbol: int) -> Queue:
        if symbol not in self.queues:
            self.queues[symbol] = Queue(self.store)
        return self.queues[symbol]

    def take(self, positions: np.ndarray, prefixes: np.ndarray, low: int, high: int) -> None:
        """Push the suffixes before `positions` that begin with a symbol from low to high."""
        before = positions - 1
        symbol = self.text[before]  # -1 wraps to the end mark, which no suffix has before it
        at = np.flatnonzero((positions > 0) & (symbol >= low) & (symbol <= high))
        if len(at):
            order = np.argsort(symbol[at], kind="stable")
            at = at[order]
            to = symbol[at].astype(np.int64)
            first = np.concatenate(([True], to[1:] != to[:-1]))
            begin = np.empty(len(at), dtype=np.int64)
            begin[1:] = at[:-1] + 1
            begin[first] = 0
            least = _range_minimum(prefixes, begin, at)
            heads = np.flatnonzero(first)
            least[heads] = np.minimum(least[heads], self.since[to[heads]])
            shared = np.minimum(least.astype(np.int64) + 1, self.length).astype(np.uint8)
            new = heads[~self.begun[to[heads]]]
            shared[new] = 0
            ends = np.append(heads[1:], len(at))
            for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
                self.queue(int(to[h])).push(before[at[h:e]], shared[h:e])
        whole = prefixes.min()
        np.minimum(self.since, whole, out=self.since)
        if len(at):
            last = at[ends - 1]
            pushed = to[heads]
            self.begun[pushed] = True
            rest = np.full(len(pushed), 255, dtype=np.uint8)
            more = np.flatnonzero(last + 1 < len(prefixes))
            if len(more):
                rest[more] = _range_minimum(prefixes, last[more] + 1, np.full(len(more), len(prefixes) - 1))
            self.since[pushed] = rest


def _run(text: np.ndarray, at: int, length: int) -> int:
    """Symbols at `at` that are equal, up to `length`."""
    part = text[at : at + length]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _star_names(text: np.ndarray, stars: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Names of the substrings from each S* position to the next, in their order."""
    size = np.empty(len(stars), dtype=np.int64)
    size[:-1], size[-1] = stars[1:] - stars[:-1] + 1, 1
    rank, offset = np.zeros(len(stars), dtype=np.int64), 0
    open_ = np.arange(len(stars))
    while len(open_):
        # One symbol and its type at a time; substrings that are told apart leave.
        inside = offset < size[open_]
        where = np.minimum(stars[open_] + offset, len(text) - 1)
        key = np.where(inside, text[where].astype(np.int64) * 2 + small[where] + 1, 0)
        order = np.lexsort((key, rank[open_]))
        r, k = rank[open_][order], key[order]
        first = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        # A group keeps its first number; its parts are numbered by the members before them.
        index = np.arange(len(r))
        base = np.maximum.accumulate(np.where(group, index, 0))
        part = np.maximum.accumulate(np.where(first, index, 0))
        rank[open_[order]] = r + (part - base)
        alone = np.diff(np.append(np.flatnonzero(first), len(r)))[np.cumsum(first) - 1] == 1
        done = alone | (k == 0)
        open_ = open_[order[~done]]
        offset += 1
    return rank


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `depth` names at least."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.cumsum(np.concatenate(([True], k[1:] != k[:-1])))
        rank[order] = new
        step *= 2
        if new[-1] == n or step >= depth:
            return order


def _star_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each S* suffix with the one before it."""
    out = np.zeros(len(order), dtype=np.uint8)
    a, b, at = order[:-1], order[1:], np.arange(1, len(order))
    last = len(text) - 1
    for _ in range(length):
        same = text[np.minimum(a, last)] == text[np.minimum(b, last)]
        same &= (a <= last) & (b <= last)
        a, b, at = a[same] + 1, b[same] + 1, at[same]
        if not len(at):
            break
        out[at] += 1
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end mark is one."""
    n = len(text)
    small = np.zeros(n, dtype=bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nearest = np.searchsorted(differs, np.arange(n - 1))
    small[:-1] = text[differs[nearest]] < text[differs[nearest] + 1]
    small[-1] = True
    return small


def _sort(text: np.ndarray, length: int, memory: int, base: int, flags: np.ndarray | None) -> np.ndarray | None:
    """Induce the order of all suffixes of a text that ends with its only 0.

    With `flags`, mark the positions that share `length` symbols with a neighbour; else return the order.
    """
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _star_names(text, stars, small)
    if len(np.unique(names)) == len(names):
        order = np.argsort(names)
    elif len(names) <= base:
        order = _doubled(names, length)
    else:
        reduced = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
        order = _sort(np.append(reduced, 0), length, memory, base, None)
        order = order[order < len(stars)]
    del small, names
    stars = stars[order]
    prefixes = _star_prefixes(text, stars, length)
    store = Store(memory)
    try:
        symbols = int(text.max()) + 1
        star_symbol = text[stars]
        cuts = np.searchsorted(star_symbol, np.arange(symbols + 1))
        up = _Induction(text, store, symbols, length)
        done: dict[int, Queue] = {}
        for c in np.flatnonzero(np.bincount(text, minlength=symbols)).tolist():
            last = None
            for positions, shared in up.queue(c).drain() if c in up.queues else ():
                done.setdefault(c, Queue(store)).push(positions, shared)
                up.take(positions, shared, c, symbols)
                last = int(positions[-1])
            for low in range(cuts[c], cuts[c + 1], _BLOCK):
                high = min(low + _BLOCK, cuts[c + 1])
                shared = prefixes[low:high].copy()
                if low == cuts[c]:
                    shared[0] = 0 if last is None else min(_run(text, last, length), _run(text, int(stars[low]), length))
                up.take(stars[low:high], shared, c + 1, symbols)
        down = _Induction(text, store, symbols, length)
        out: list[np.ndarray] = []

        def mark(positions: np.ndarray, shared: np.ndarray, behind: int | None) -> int | None:
            """`shared` is with the next larger suffix, which `behind` is for the first."""
            if flags is not None:
                hit = shared >= length
                flags[positions[hit]] = True
                flags[positions[:-1][hit[1:]]] = True
                if hit[0] and behind is not None:
                    flags[behind] = True
            else:
                out.append(positions)
            return int(positions[-1])

        for c in range(symbols - 1, -1, -1):
            behind = least = None
            if c in down.queues:
                for positions, shared in down.queues[c].drain():
                    behind = mark(positions, shared, behind)
                    down.take(positions, shared, 0, c)
                least = behind
            if c not in done:
                continue
            carry = 0  # what the next smaller suffix shares with the block's least
            head = True
            for positions, shared in done[c].backwards():
                toward = np.empty_like(shared)
                toward[1:] = shared[:-1]
                toward[0] = carry
                if head and least is not None:
                    toward[0] = min(_run(text, int(positions[0]), length), _run(text, least, length))
                head, carry = False, int(shared[-1])
                behind = mark(positions, toward, behind)
                down.take(positions, toward, 0, c - 1)
        if flags is not None:
            return None
        out.append(np.array([len(text) - 1]))
        return np.concatenate(out)[::-1]
    finally:
        store.close()


def repeated_positions(text: np.ndarray, length: int = 200, memory: int = 64 << 20, base: int = 1 << 22) -> np.ndarray:
    """For every position, whether its suffix shares `length` (at most 254) symbols with another one.

    `text` has whole numbers from 1 on.  `memory` bounds the tuples held outside files, `base` the names
    sorted by doubling.
    """
    flags = np.zeros(len(text) + 1, dtype=bool)
    if len(text):
        _sort(np.append(text, text.dtype.type(0)), length, memory, base, flags)
    return flags[:-1]
