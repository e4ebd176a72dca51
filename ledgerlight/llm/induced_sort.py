"""Suffix order of a text with common-prefix lengths, by induced sorting through queues on disk.

Suffixes that start a fall-to-rise of the text (S*) are sorted by names of the pieces between them, one level of
recursion that doubles the named length until it covers the prefix of interest. All others are induced: a bucket queue
per first symbol holds tuples of position and common prefix with the tuple before; taking tuples in order and putting
their predecessors into the queues of their own first symbols leaves every queue in order, once upwards for suffixes
that fall and once downwards for those that rise. The common prefix of two tuples in a queue is one more than the least
one among the tuples taken between the two that they come from. Queues keep a bounded number of tuples in memory and the
rest in an unnamed file, so a text may be far larger than memory.

Prefixes are measured up to a limit; suffixes that agree that far may stand in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

END, BREAK, FIRST = 0, 1, 2  # end of the text, end of one of its strings, and byte 0
SYMBOLS = FIRST + 256
#: Tuples that all queues of a sort hold in memory.
HELD_TUPLES = 8_000_000
TAKEN_TUPLES = 500_000


class Queue:
    """Tuples of (position, common prefix), first in, first out."""

    def __init__(self, spill: Spill):
        self.spill, self.parts = spill, []

    def put(self, at: np.ndarray, common: np.ndarray) -> None:
        if len(at):
            self.parts.append(self.spill.keep(at, common))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """What is there, up to about ``TAKEN_TUPLES``."""
        taken, size = [], 0
        while self.parts and size < TAKEN_TUPLES:
            taken.append(self.spill.give(self.parts.pop(0)))
            size += len(taken[-1][0])
        return (np.concatenate([at for at, _ in taken]), np.concatenate([common for _, common in taken]))


class Spill:
    """Arrays in memory up to a number of tuples, then in one file that has no name and goes with its last user."""

    def __init__(self, held: int):
        self.left, self.file = held, None

    def keep(self, at: np.ndarray, common: np.ndarray):
        if len(at) <= self.left:
            self.left -= len(at)
            return at, common
        self.file = self.file or tempfile.TemporaryFile()
        start = self.file.seek(0, 2)
        at.tofile(self.file)
        common.tofile(self.file)
        return start, len(at)

    def give(self, part) -> tuple[np.ndarray, np.ndarray]:
        first, second = part
        if isinstance(first, np.ndarray):
            self.left += len(first)
            return first, second
        self.file.seek(first)
        at = np.fromfile(self.file, dtype=np.int64, count=second)
        return at, np.fromfile(self.file, dtype=np.int16, count=second)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, ``limit`` at most."""
    out = np.zeros(len(a), dtype=np.int16)
    live = np.arange(len(a))
    for k in range(limit):
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] += 1
    return out


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Least value over after+1..upto for each pair, from least values of power-of-two runs."""
    length = upto - after
    if not len(length):
        return np.zeros(0, dtype=values.dtype)
    out = np.empty(len(after), dtype=values.dtype)
    level = np.frexp(length.astype(np.float64))[1] - 1  # floor of log2
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-width // 2 or None], table[width // 2:])
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[after[mine] + 1], table[upto[mine] - width + 1])
        width *= 2
    return out


class _Inducer:
    """Puts predecessors of tuples into queues by first symbol, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, limit: int, spill: Spill):
        self.text, self.wanted, self.limit = text, wanted, limit
        self.queues = [Queue(spill) for _ in range(SYMBOLS)]
        self.run = np.full(SYMBOLS, -1, dtype=np.int16)  # least common prefix since the last of a queue; -1: none yet

    def scan(self, at: np.ndarray, common: np.ndarray) -> None:
        if not len(at):
            return
        from_ = np.flatnonzero(at > 0)
        from_ = from_[self.wanted[at[from_] - 1]]
        symbol = self.text[at[from_] - 1]
        turn = np.argsort(symbol, kind="stable")
        from_, symbol = from_[turn], symbol[turn]
        starts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1]))) if len(symbol) else np.zeros(0, np.int64)
        own = np.empty(len(from_), dtype=np.int16)
        later = np.ones(len(from_), dtype=bool)
        later[starts] = False
        inner = np.flatnonzero(later)
        own[inner] = _least_between(common, from_[inner - 1], from_[inner])
        heads, groups = np.minimum.accumulate(common), symbol[starts]
        own[starts] = np.minimum(self.run[groups], heads[from_[starts]])
        tails = np.concatenate((np.minimum.accumulate(common[::-1])[::-1][1:], [self.limit]))
        self.run = np.where(self.run >= 0, np.minimum(self.run, heads[-1]), self.run)
        ends = np.concatenate((starts[1:], [len(from_)])) if len(starts) else starts
        if len(starts):
            self.run[groups] = tails[from_[ends - 1]]
        own = np.minimum(own + 1, self.limit).astype(np.int16)
        for symbol_, a, b in zip(groups.tolist(), starts.tolist(), ends.tolist(), strict=True):
            self.queues[symbol_].put(at[from_[a:b]] - 1, own[a:b])


def _falls(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than the next one; the last one is not."""
    change = np.flatnonzero(text[1:] != text[:-1])
    next_change = change[np.minimum(np.searchsorted(change, np.arange(len(text))), len(change) - 1)] if len(change) else []
    out = np.zeros(len(text), dtype=bool)
    if len(change):
        out[:-1] = text[next_change[:-1]] > text[next_change[:-1] + 1]
    out[-1] = False
    return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _sorted_starts(text: np.ndarray, falls: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """S* positions in the order of their suffixes, as far as ``limit`` symbols tell."""
    ends = np.concatenate((starts[1:], [len(falls) - 1]))
    names, live, done = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), 0
    symbols = (text[:len(falls)].astype(np.int64) << 1 | ~falls) + 1  # nothing beyond a piece's end: 0
    while len(live):  # pieces longer than what is named so far, six symbols at a time
        word = np.zeros(len(live), dtype=np.int64)
        for k in range(done, done + 6):
            where = starts[live] + k
            inside = where <= ends[live]
            word = (word << 10) | np.where(inside, symbols[np.minimum(where, len(symbols) - 1)], 0)
        full = np.zeros(len(starts), dtype=np.int64)
        full[live] = word
        names = _dense(np.lexsort((full, names)), names, full)
        done += 6
        live = live[starts[live] + done <= ends[live]]
    width = 1
    while width < limit and names.max(initial=0) + 1 < len(names):  # each piece adds two symbols or more
        behind = np.zeros(len(names), dtype=np.int64)
        behind[:-width] = names[width:] + 1
        key = names * (len(names) + 1) + behind
        names = _dense(np.argsort(key, kind="stable"), key)
        width *= 2
    return starts[np.argsort(names, kind="stable")]


def sorted_suffixes(text: np.ndarray, limit: int, held: int = HELD_TUPLES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (positions, common prefix with the suffix before), in order. ``text`` ends in the only ``END``."""
    n = len(text)
    falls = _falls(text)
    padded = np.concatenate((text, np.zeros(limit, dtype=text.dtype)))
    starts = np.flatnonzero(~falls[1:] & falls[:-1]) + 1
    if n == 1 or not len(starts):
        starts = np.array([n - 1])
    spill = Spill(held)
    seeds = _sorted_starts(padded, falls, starts, limit)
    seed_common = np.concatenate(([0], common_prefix(padded, seeds[:-1], seeds[1:], limit))).astype(np.int16)
    seed_symbol = padded[seeds]
    cuts = np.searchsorted(seed_symbol, np.arange(SYMBOLS + 1))

    def across(before: int | None, after: int) -> int:
        return 0 if before is None else int(common_prefix(padded, np.array([before]), np.array([after]), limit)[0])

    falling = _Inducer(padded, falls, limit, spill)
    fallen = [Queue(spill) for _ in range(SYMBOLS)]
    edge: list[int | None] = []  # last falling suffix of each symbol
    for c in range(SYMBOLS):
        queue, last = falling.queues[c], None
        while queue.parts:
            at, common = queue.take()
            last = int(at[-1])
            fallen[c].put(at, common)
            falling.scan(at, common)
        edge.append(last)
        at, common = seeds[cuts[c]:cuts[c + 1]], seed_common[cuts[c]:cuts[c + 1]].copy()
        if len(at):
            common[0] = across(last, int(at[0]))
            falling.scan(at, common)
    rising = _Inducer(padded, ~falls, limit, spill)
    parts: list[list] = [[] for _ in range(SYMBOLS)]
    for c in reversed(range(SYMBOLS)):
        queue, risen, last = rising.queues[c], Queue(spill), None
        while queue.parts:
            at, common = queue.take()
            last = int(at[-1])
            risen.put(at, common)
            rising.scan(at, common)
        if c == END:
            risen.put(np.array([n - 1]), np.zeros(1, dtype=np.int16))
            last = n - 1
        before = across(last, edge[c]) if last is not None and edge[c] is not None else 0
        parts[c] = [fallen[c], risen, before]
        # Down through the falling ones: each tuple's common prefix is that of the one above it.
        above = before
        for part in reversed(fallen[c].parts):
            at, common = part if isinstance(part[0], np.ndarray) else spill.give(part)
            down = np.concatenate((common[1:], [above]))[::-1].astype(np.int16)
            above = common[0]
            rising.scan(at[::-1], down)
    for low, high, between in parts:
        for part in low.parts:
            yield part if isinstance(part[0], np.ndarray) else spill.give(part)
        below = between
        for part in reversed(high.parts):
            at, common = part if isinstance(part[0], np.ndarray) else spill.give(part)
            up = np.concatenate((common[1:], [below]))[::-1].astype(np.int16)
            below = common[0]
            yield at[::-1], up
