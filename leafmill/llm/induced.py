"""Suffix and common-prefix arrays by external induced sorting.

The suffixes that begin a rise (LMS suffixes) are sorted by recursion on the string of their names.
From them, one pass in ascending order induces all falling (L) suffixes and one in descending order
all rising (S) suffixes: whenever a suffix leaves the queue, the one before it enters with its first
symbol as priority, first come first served. Each tuple carries its common prefix with the tuple
before it in that queue: one more than the least common prefix among what left the queue between
their two sources.

The queue keeps at most `limit` tuples in memory; beyond that it writes them to a run on disk, sorted
by priority, and reads a priority's part of each run when its turn comes. The substrings to be named
are sorted in runs on disk as well. The symbols themselves, the run lengths and the two results stay in
memory: some 30 bytes a symbol.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

#: Tuples that a queue, and entries that a sort, keep in memory: most shards have more, so they go through
#: the disk. A larger text has longer runs, so that it never needs more than MOST_RUNS of them at once.
LIMIT, MOST_RUNS = 1 << 16, 256
#: Above every symbol that a str can compare.
TOP = 0x10FFFF


def spool():
    """A file on the executor's own disk, gone as soon as it is closed or its process ends: what it holds is
    made anew by a task that runs again."""
    at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=at if os.path.isdir(at) else None)


class DiskQueue:
    """Priority queue of (symbol, position, prefix), first come first served within a symbol."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit, self.held = limit, 0
        self.positions: dict[int, array] = {}
        self.prefixes: dict[int, array] = {}
        self.runs: list[tuple[object, dict[int, tuple[int, int]]]] = []

    def push(self, symbol: int, position: int, prefix: int) -> None:
        if (p := self.positions.get(symbol)) is None:
            p = self.positions[symbol] = array("q")
            self.prefixes[symbol] = array("q")
        p.append(position)
        self.prefixes[symbol].append(prefix)
        self.held += 1
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        f = spool()
        index = {}
        for s in sorted(self.positions):
            index[s] = (f.tell(), len(self.positions[s]))
            self.positions[s].tofile(f)
            self.prefixes[s].tofile(f)
        self.runs.append((f, index))
        self.positions, self.prefixes, self.held = {}, {}, 0

    def take(self, symbol: int) -> tuple[array, array]:
        """All tuples of a symbol that have come so far, in the order in which they came."""
        positions, prefixes = array("q"), array("q")
        for f, index in self.runs:
            if symbol in index:
                at, n = index.pop(symbol)
                f.seek(at)  # type: ignore[attr-defined]
                positions.fromfile(f, n)
                prefixes.fromfile(f, n)
        if symbol in self.positions:
            own = self.positions.pop(symbol)
            self.held -= len(own)
            positions.extend(own)
            prefixes.extend(self.prefixes.pop(symbol))
        return positions, prefixes


class RunningMin:
    """Least value among those given since a point: a stack of values that rise."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.value: list[int] = []
        self.n = 0

    def add(self, value: int) -> None:
        at, values = self.at, self.value
        while values and values[-1] >= value:
            values.pop()
            at.pop()
        at.append(self.n)
        values.append(value)
        self.n += 1

    def since(self, point: int) -> int:
        """Least of the values number point, point + 1, ..."""
        return self.value[bisect_left(self.at, point)]


def _sorted_externally(items: Iterator[tuple], limit: int) -> Iterator[tuple]:
    runs, own = [], []

    def read(f) -> Iterator[tuple]:
        f.seek(0)
        while part := pickle.load(f):
            yield from part

    for x in items:
        own.append(x)
        if len(own) >= limit:
            own.sort()
            f = spool()
            for i in range(0, len(own), 10_000):
                pickle.dump(own[i : i + 10_000], f, -1)
            pickle.dump([], f, -1)
            runs.append(read(f))
            own = []
    own.sort()
    return heapq.merge(*runs, own) if runs else iter(own)


def suffix_array(text: Sequence[int], limit: int = LIMIT) -> tuple[array, array]:
    """The positions of all suffixes in ascending order, and each one's common prefix with the one
    before it (0 for the first). A suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return array("q"), array("q")
    limit = max(limit, n // MOST_RUNS)
    # Whether a suffix is smaller than the next one (S); the last is larger than the empty one (L).
    rising = bytearray(n + 1)
    rising[n] = 1
    run = array("q", bytes(8 * n))  # length of the run of the first symbol
    later, length = -1, 0
    for i in range(n - 1, -1, -1):
        c = text[i]
        if c == later:
            rising[i] = rising[i + 1] if i + 1 < n else 0
            length += 1
        else:
            rising[i] = c < later
            length = 1
        run[i] = length
        later = c
    lms = [i for i in range(1, n) if rising[i] and not rising[i - 1]]
    lms_order, lms_prefix = _order_lms(text, lms, limit)

    # Ascending: L suffixes, from LMS suffixes and from L suffixes; the empty suffix comes first of all.
    seeds: dict[int, list[int]] = {}
    for k, i in enumerate(lms_order):
        seeds.setdefault(text[i], []).append(k)
    queue, seen, source = DiskQueue(limit), RunningMin(), {}
    alphabet = sorted(set(text))
    seen.add(0)
    queue.push(text[n - 1], n - 1, 0)
    source[text[n - 1]] = 0
    falling = DiskQueue(limit)

    def induce(i: int, number: int, wanted: int) -> None:
        """The suffix before i enters, if it is of the kind wanted."""
        if i and rising[i - 1] == wanted:
            c = text[i - 1]
            before = source.get(c)
            queue.push(c, i - 1, 0 if before is None else 1 + seen.since(before + 1))
            source[c] = number

    number = 1
    for c in alphabet:
        last = -1
        while True:
            positions, prefixes = queue.take(c)
            if not positions:
                break
            for i, p in zip(positions, prefixes, strict=True):
                seen.add(p)
                falling.push(c, i, p)
                induce(i, number, 0)
                number += 1
                last = i
        for k in seeds.get(c, ()):
            i = lms_order[k]
            if last < 0:
                p = 0
            elif rising[last]:
                p = lms_prefix[k]
            else:
                p = min(run[last], run[i])
            seen.add(p)
            induce(i, number, 0)
            number += 1
            last = i

    # Descending: S suffixes, from L suffixes and from S suffixes. A common prefix belongs to the pair
    # of a suffix and the one that left before it, which is the larger one.
    queue, seen, source = DiskQueue(limit), RunningMin(), {}
    out, common = array("q"), array("q")
    number = 0
    for c in reversed(alphabet):
        last = -1
        while True:
            positions, prefixes = queue.take(c)
            if not positions:
                break
            for i, p in zip(positions, prefixes, strict=True):
                seen.add(p)
                out.append(i)
                common.append(p)
                induce(i, number, 1)
                number += 1
                last = i
        positions, prefixes = falling.take(c)
        after = 0
        for i, p in zip(reversed(positions), reversed(prefixes), strict=True):
            if last < 0:
                q = 0
            elif rising[last]:
                q = min(run[last], run[i])
            else:
                q = after
            seen.add(q)
            out.append(i)
            common.append(q)
            induce(i, number, 1)
            number += 1
            last, after = i, p
    out.reverse()
    common.reverse()
    return out, array("q", [0]) + common[:-1] if n > 1 else array("q", [0])


def _order_lms(text: Sequence[int], lms: list[int], limit: int) -> tuple[list[int], list[int]]:
    """LMS suffixes in ascending order, and their common prefixes with the one before."""
    if not lms:
        return [], []
    n = len(text)
    wide = max(text) >= TOP
    symbols = text if wide else "".join(map(chr, text))
    ends = [*lms[1:], n - 1]

    def parts() -> Iterator[tuple]:
        for k, (i, j) in enumerate(zip(lms, ends, strict=True)):
            # Whoever ends at a next LMS position rises there; whoever goes on with equal symbols falls.
            # The last one meets the end of the text, which is less than all.
            part = symbols[i : j + 1]
            stop = k + 1 < len(lms)
            yield ((*part, TOP << 32) if stop else tuple(part), k) if wide else (part + chr(TOP) if stop else part, k)

    names, name, before = [0] * len(lms), -1, None
    for part, k in _sorted_externally(parts(), limit):
        if part != before:
            name, before = name + 1, part
        names[k] = name
    if name + 1 == len(lms):
        order = [0] * len(lms)
        for k, x in enumerate(names):
            order[x] = k
        shared = [0] * len(lms)
    else:
        order, shared = (list(x) for x in suffix_array(names, limit))
    prefix = [0] * len(lms)
    for r in range(1, len(order)):
        a, z, h = order[r - 1], order[r], shared[r]
        i, j = (lms[x + h] if x + h < len(lms) else n for x in (a, z))
        p = i - lms[a]
        while i < n and j < n and text[i] == text[j]:
            i, j, p = i + 1, j + 1, p + 1
        prefix[r] = p
    return [lms[k] for k in order], prefix
