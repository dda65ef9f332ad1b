"""External induced sorting of suffixes, with common prefixes.

The suffixes of a text are sorted from its S* suffixes (the left ends of rising stretches): one round of induction
sorts and names the S* substrings, the string of names is sorted by the same induction, recursively, and the sorted
S* suffixes induce all others, first the L-type ones in rising, then the S-type ones in falling order.

The tuples under way (symbol, position, common prefix with the tuple before it) wait in a priority queue of sorted
runs: small runs are merged in groups, large ones are written to disk and read from their fronts. The queue is
emptied by windows of symbols which induce nothing into themselves, or by a single symbol in rounds, so that large
alphabets (names) and small ones (bytes) take the same path.

Common prefixes are carried through every step and never found by hashing: the prefix of two induced neighbours is
one symbol more than the least prefix between the tuples that induced them; prefixes of S* substrings, and with
them prefixes of names, become prefixes of S* suffixes by a range minimum. They are exact up to ``cap``.

Memory: queues hold at most about ``memory`` bytes each and steps ``PART`` rows. Whatever grows with the text (the
text itself, names, S* positions, sorted tuples, tables for range minima) lies in files that are memory-mapped.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Bytes of waiting tuples that a queue keeps in memory.
MEMORY = 16 << 20
#: Rows that are processed together.
PART = 1 << 17
#: Runs of about one size that are merged into one.
FAN = 8
#: Rows that a window of several symbols should hold.
WINDOW = 16384
#: The recursion ends with a string of at most so many names, which is sorted in memory (about 60 MB for 2**21).
BASE = 1 << 21

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def mapped(folder: str, kind: str, n: int) -> np.ndarray:
    """A new array of ``n`` zeros in a file of the folder; the file goes with the last use."""
    handle, path = tempfile.mkstemp(dir=folder)
    os.ftruncate(handle, max(1, n) * np.dtype(kind).itemsize)
    os.close(handle)
    out = np.memmap(path, kind, "r+", shape=(max(1, n),)).view(np.ndarray)[:n]
    os.remove(path)
    return out


class Spool:
    """Columns that are appended in blocks and afterwards read as memory-mapped arrays."""

    def __init__(self, folder: str, *kinds: str):
        self.kinds, self.n = kinds, 0
        self.files = [tempfile.TemporaryFile(dir=folder) for _ in kinds]

    def add(self, *columns: np.ndarray) -> None:
        for f, kind, c in zip(self.files, self.kinds, columns):
            f.write(np.ascontiguousarray(c, kind).data)
        self.n += len(columns[0])

    def arrays(self) -> list[np.ndarray]:
        out = []
        for f, kind in zip(self.files, self.kinds):
            f.flush()
            out.append(np.memmap(f, kind, "r", shape=(self.n,)).view(np.ndarray) if self.n else np.zeros(0, kind))
            f.close()
        return out


class Run:
    """Rows (key, position, common prefix) with rising keys, taken from the front."""

    def __init__(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray):
        self.columns, self.at, self.n = (key, pos, lcp), 0, len(key)

    def until(self, below: int) -> int:
        return bisect_left(self.columns[0], below, self.at, self.n)

    def rows(self, a: int, b: int) -> Rows:
        key, pos, lcp = self.columns
        return key[a:b], pos[a:b], lcp[a:b]


def falling_run(key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> Run:
    """The rows backwards: each prefix then belongs to the row that comes next."""
    return Run(key[::-1], pos[::-1], _Shifted(lcp))


class _Shifted:
    """``lcp[1:]`` and a 0, read backwards, without a copy of the whole."""

    def __init__(self, lcp: np.ndarray):
        self.lcp = lcp

    def __getitem__(self, part: slice) -> np.ndarray:
        n, a, b = len(self.lcp), part.start, part.stop
        if a > 0:
            return self.lcp[n - b + 1 : n - a + 1][::-1]
        return np.r_[np.zeros(min(b, 1), self.lcp.dtype), self.lcp[n - b + 1 : n][::-1]]


class Queue:
    """A priority queue of rows by key; rows with one key leave in the order in which they came."""

    def __init__(self, folder: str, memory: int = MEMORY, runs: list[Run] | None = None):
        self.folder, self.memory, self.runs = folder, memory, runs or []  # oldest first
        self.level: list[int] = [99] * len(self.runs)

    def push(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Add rows with rising keys."""
        if not len(key):
            return
        self._add(key, pos, lcp)
        while len(self.runs) >= FAN and self.level[-FAN] <= self.level[-1] < 99 and min(self.level[-FAN:]) >= 0:
            parts = [r.rows(r.at, r.n) for r in self.runs[-FAN:] if r.at < r.n]
            del self.runs[-FAN:], self.level[-FAN:]
            if parts:
                self._add(*_sorted(parts))

    def _add(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = len(key) * 16
        if size * FAN > self.memory:
            rows = []
            for column, kind in zip((key, pos, lcp), ("i4", "i8", "i4")):
                rows.append(mapped(self.folder, kind, len(key)))
                rows[-1][:] = column
            self.runs.append(Run(*rows))
            self.level.append(99)
        else:
            self.runs.append(Run(key, pos, lcp))
            self.level.append(max(0, (len(key) >> 7).bit_length() // 3))

    def first_key(self) -> int | None:
        return min((int(r.columns[0][r.at]) for r in self.runs if r.at < r.n), default=None)

    def count(self, below: int) -> int:
        return sum(r.until(below) - r.at for r in self.runs)

    def peek(self, below: int) -> Rows:
        """The rows with keys under ``below``, by key and age."""
        return _sorted([r.rows(r.at, b) for r in self.runs if (b := r.until(below)) > r.at])

    def skip(self, below: int) -> None:
        for r in self.runs:
            r.at = r.until(below)
        keep = [i for i, r in enumerate(self.runs) if r.at < r.n]
        if len(keep) < len(self.runs):
            self.runs, self.level = [self.runs[i] for i in keep], [self.level[i] for i in keep]

    def take_one(self, key: int) -> Iterator[Rows]:
        """Remove the rows of the smallest key so far, in parts by age."""
        found = [(r, r.at, r.until(key + 1)) for r in self.runs]
        self.skip(key + 1)
        for r, a, b in found:
            for lo in range(a, b, PART):
                yield r.rows(lo, min(b, lo + PART))


def _heads(key: np.ndarray) -> np.ndarray:
    """Whether each of one or more rows begins a new key."""
    out = np.empty(len(key), bool)
    out[0] = True
    np.not_equal(key[1:], key[:-1], out=out[1:])
    return out


def _before(first: int, values: np.ndarray) -> np.ndarray:
    """``values`` moved by one place behind ``first``."""
    out = np.empty_like(values)
    out[0], out[1:] = first, values[:-1]
    return out


def _sorted(parts: list[Rows]) -> Rows:
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    key, pos, lcp = (np.concatenate(c) for c in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(key, kind="stable")
        key, pos, lcp = key[order], pos[order], lcp[order]
    return key, pos, lcp


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the values from each ``a`` to ``b``, by a sparse table."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, : len(values) - half])
    return np.minimum(table[level, a], table[level, b - (1 << level) + 1])


class _Carry:
    """Common prefixes of induced tuples: one more than the least prefix since the last tuple of the same symbol."""

    def __init__(self, symbols: int, cap: int, folder: str):
        self.cap, self.blocks = cap, 0
        small = symbols <= 1 << 16
        self.block = np.zeros(symbols, np.int32) if small else mapped(folder, "i4", symbols)  # 1 + block of the last tuple
        self.rest = np.zeros(symbols, np.int32) if small else mapped(folder, "i4", symbols)  # least prefix after it in that block
        self.later = np.zeros(64, np.int32)  # least prefix of the blocks after each block

    def __call__(self, lcp: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Prefixes of tuples that rows ``at`` of a block induce, ordered by their ``key`` and row."""
        n = len(lcp)
        if self.blocks + 2 > len(self.later):
            self.later = np.r_[self.later, np.zeros_like(self.later)]
        if len(at):
            new = np.flatnonzero(_heads(key))
            seen = key[new]
            ahead = np.minimum.accumulate(lcp)
            if len(new) < len(at):
                before = _before(-1, at) + 1
                before[new] = at[new]
                low = _least(lcp, before, at)
            else:
                low = np.empty(len(at), lcp.dtype)
            block = self.block[seen]
            held = np.where(block > 0, np.minimum(self.rest[seen], self.later[block]), 0)
            low[new] = np.minimum(held, ahead[at[new]])
            end = np.empty_like(new)
            end[:-1], end[-1] = at[new[1:] - 1], at[-1]
            behind = np.full(n + 1, self.cap, lcp.dtype)
            behind[:n] = np.minimum.accumulate(lcp[::-1])[::-1]
            self.block[seen], self.rest[seen] = self.blocks + 1, behind[end + 1]
            out = np.minimum(low + 1, self.cap).astype(np.int32)
        else:
            out = np.zeros(0, np.int32)
        if n:
            least = lcp.min()
            np.minimum(self.later[: self.blocks + 1], least, out=self.later[: self.blocks + 1])
        self.blocks += 1
        self.later[self.blocks] = self.cap
        return out


def _runs(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How often the first symbol repeats from both ``a`` and ``b`` on (the smaller number), up to ``cap``."""
    out, todo, c = np.ones(len(a), np.int32), np.arange(len(a)), text[a]
    while len(todo):
        k = out[todo]
        todo = todo[(k < cap) & (np.maximum(a[todo], b[todo]) + k < len(text))]
        k = out[todo]
        todo = todo[(text[a[todo] + k] == c[todo]) & (text[b[todo] + k] == c[todo])]
        out[todo] += 1
    return out


def _sweep(text: np.ndarray, symbols: int, cap: int, folder: str, memory: int, second: Queue, down: bool, ends: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Induce one type from the ``second`` rows: (key, position, prefix, whether induced, whether S*) in order of the
    key, which is the symbol, or (``down``) the number of larger symbols.

    With ``ends``, second rows stand for the last symbol of an S* substring and have no more than it in common."""
    queue, carry = Queue(folder, memory), _Carry(symbols, cap, folder)
    top = symbols - 1

    def ahead(key: np.ndarray, pos: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key of the position before, whether it is of the type to induce)."""
        child = text[np.maximum(pos - 1, 0)].astype(np.int32)
        child = top - child if down else child
        return child, (pos > 0) & ((child > key) | ((child == key) & own))

    def deal(pos: np.ndarray, lcp: np.ndarray, child: np.ndarray, fit: np.ndarray) -> None:
        at = np.flatnonzero(fit)
        at = at[np.argsort(child[at], kind="stable")]
        key = child[at]
        queue.push(key, pos[at] - 1, carry(lcp, at, key))

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ones(len(a), np.int32) if ends else _runs(text, a, b, cap)

    step, low = 1, 0
    while True:
        low = min((k for q in (queue, second) if (k := q.first_key()) is not None), default=-1)
        if low < 0:
            return
        high = low + step
        while (n := queue.count(high) + second.count(high)) > PART and high > low + 1:
            high = low + (high - low) // 2
        if high > low + 1 or n <= PART:
            k1, p1, l1 = queue.peek(high)
            k2, p2, l2 = second.peek(high)
            if len(k2):
                key, pos, lcp = np.concatenate([k1, k2]), np.concatenate([p1, p2]), np.concatenate([l1, l2])
                order = np.argsort(key, kind="stable")
                key, pos, lcp, own = key[order], pos[order], lcp[order], order < len(k1)
            else:
                key, pos, lcp, own = k1, p1, l1, np.ones(len(k1), bool)
            child, fit = ahead(key, pos, own)
            inner = child[fit & (child < high)]
            stop = int(inner.min()) if len(inner) else high
            if stop > low:
                m = len(key) if stop == high else int(np.searchsorted(key, stop))
                key, pos, lcp, own, child, fit = (x[:m] for x in (key, pos, lcp, own, child, fit))
                new = _heads(key)
                lcp[new] = 0
                edge = np.flatnonzero(~new & ~own & _before(False, own))
                lcp[edge] = meet(pos[edge - 1], pos[edge])
                queue.skip(stop)
                second.skip(stop)
                yield key, pos, lcp, own, own & (child < key) & (pos > 0)
                deal(pos, lcp, child, fit)
                step = min(symbols, step * 2) if stop == high and m < WINDOW else max(1, step // 2) if stop < high or m > 2 * WINDOW else step
                continue
        step, last = 1, None
        while queue.first_key() == low:
            for key, pos, lcp in queue.take_one(low):
                lcp = np.array(lcp)
                if last is None:
                    lcp[0] = 0
                own = np.ones(len(key), bool)
                child, fit = ahead(key, pos, own)
                yield key, pos, lcp, own, (child < key) & (pos > 0)
                deal(pos, lcp, child, fit)
                last = int(pos[-1])
        first = True
        for key, pos, lcp in second.take_one(low):
            lcp = np.array(lcp)
            if first:
                lcp[0] = 0 if last is None else meet(np.array([last]), np.asarray(pos[:1]))[0]
                first = False
            own = np.zeros(len(key), bool)
            child, fit = ahead(key, pos, own)
            yield key, pos, lcp, own, own
            deal(pos, lcp, child, fit)


def _induce(text: np.ndarray, seeds: Queue, symbols: int, cap: int, folder: str, memory: int, ends: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, prefix with the suffix before, whether S*) of all suffixes in falling order, from the S* suffixes
    in ``seeds``; the last symbol of the text comes last."""
    kept = Spool(folder, "i4", "i8", "i4")
    for key, pos, lcp, own, _ in _sweep(text, symbols, cap, folder, memory, seeds, False, ends):
        kept.add(symbols - 1 - key[own], pos[own], lcp[own])
    larger = Queue(folder, memory, [falling_run(*kept.arrays())])
    last = None
    for _, pos, lcp, _, star in _sweep(text, symbols, cap, folder, memory, larger, True, False):
        yield pos, lcp, star
        last = int(pos[-1])
    n = len(text)
    yield np.array([n - 1]), np.array([last is not None and text[last] == text[-1]], np.int32), np.array([text[n - 2] > text[n - 1]])


def _starts(text: np.ndarray, folder: str) -> np.ndarray:
    """Positions of the S* suffixes, rising."""
    out, n = Spool(folder, "i8"), len(text)
    for a in range(0, n, PART):
        b = min(n, a + PART)
        t = text[max(a - 1, 0) : min(b + 1, n)].astype(np.int32)
        rise = np.sign(np.diff(t))
        if b == n:
            rise = np.r_[rise, 1]
        end = len(rise) - 1
        if rise[end] == 0:  # the type of the block's last run of equal symbols shows beyond the block
            at = b + 1
            while at < n and (text[at : at + PART] == text[b]).all():
                at += PART
            tail = text[at : at + PART]
            other = np.flatnonzero(tail != text[b])
            rise[end] = 1 if not len(other) or tail[other[0]] > text[b] else -1
        known = np.flatnonzero(rise)
        small = rise[known][np.searchsorted(known, np.arange(len(rise)))] > 0
        # t starts one position before the block (but for the first block)
        if a == 0:
            small = np.r_[True, small]
        star = small[1:] & ~small[:-1]
        out.add(np.flatnonzero(star) + a)
    return out.arrays()[0]


class _Minima:
    """Least values of ranges of a mapped array, by a sparse table in files."""

    def __init__(self, values: np.ndarray, folder: str):
        n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= n:
            half, below = 1 << (len(self.rows) - 1), self.rows[-1]
            row = mapped(folder, "i4", n - 2 * half + 1)
            for a in range(0, len(row), PART):
                b = min(len(row), a + PART)
                row[a:b] = np.minimum(below[a:b], below[a + half : b + half])
            self.rows.append(row)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        return out


def _name(text: np.ndarray, starts: np.ndarray, symbols: int, cap: int, folder: str, memory: int) -> tuple[np.ndarray, int, np.ndarray, list[np.ndarray]]:
    """Names of the S* substrings by the first induction: (names, their number, the prefix of each name with the next
    larger one, falling, and the falling S* positions with prefixes)."""
    n, m = len(text), len(starts)
    seeds = Queue(folder, memory)
    for a in range(0, m, PART):
        pos = np.array(starts[a : a + PART])
        key = text[pos].astype(np.int32)
        order = np.argsort(key, kind="stable")
        seeds.push(key[order], pos[order], np.ones(len(pos), np.int32))
    names, prefixes, found = mapped(folder, "i4", m), Spool(folder, "i4"), Spool(folder, "i8", "i4")
    number, size, least = -1, -1, cap
    for pos, lcp, star in _induce(text, seeds, symbols, cap, folder, memory, True):
        at = np.flatnonzero(star)
        if not len(at):
            least = min(least, int(lcp.min())) if len(lcp) else least
            continue
        low = np.minimum.reduceat(lcp[: at[-1] + 1], _before(-1, at) + 1).astype(np.int64)
        low[0] = min(int(low[0]), least)
        least = int(lcp[at[-1] + 1 :].min()) if at[-1] + 1 < len(lcp) else cap
        pos = pos[at]
        index = np.searchsorted(starts, pos)
        length = np.where(index + 1 < m, starts[np.minimum(index + 1, m - 1)] + 1, n) - pos
        same = (length == _before(size, length)) & ((low >= length) | (low >= cap))
        value = number + np.cumsum(~same)
        names[index] = value
        prefixes.add(low[~same])
        found.add(pos, low)
        number, size = int(value[-1]), int(length[-1])
    for a in range(0, m, PART):
        names[a : a + PART] = number - names[a : a + PART]
    return names, number + 1, prefixes.arrays()[0], found.arrays()


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray, cap: int) -> np.ndarray:
    """Prefixes that stop at the end of an S* substring, made longer by the run of symbols that may follow."""
    lcp = np.minimum(lcp, cap)
    todo = np.arange(len(lcp))
    while len(todo):
        k = lcp[todo]
        todo = todo[(k < cap) & (np.maximum(a[todo], b[todo]) + k < len(text))]
        k = lcp[todo]
        todo = todo[text[a[todo] + k] == text[b[todo] + k]]
        lcp[todo] += 1
    return lcp


def _sorted_starts(text: np.ndarray, starts: np.ndarray, symbols: int, cap: int, folder: str, memory: int) -> Run:
    """The S* suffixes in rising order, with common prefixes."""
    m = len(starts)
    names, kinds, prefixes, rough = _name(text, starts, symbols, cap, folder, memory)
    out = Spool(folder, "i4", "i8", "i4")
    before = -1
    if kinds == m or cap <= 2:
        for a in range(0, m, PART):
            pos, lcp = np.array(rough[0][a : a + PART]), np.array(rough[1][a : a + PART], np.int64)
            prev = _before(before, pos)
            lcp = _extend(text, np.where(prev < 0, pos, prev), pos, lcp, cap)
            out.add(text[pos], pos, lcp)
            before = int(pos[-1])
    else:
        del rough
        half, least = (cap + 1) // 2, _Minima(prefixes, folder)
        for index, lcp in _doubled(names, half, folder) if m <= BASE else falling(names, kinds, half, folder, memory):
            prev = _before(before, index)
            before = int(index[-1])
            known = np.flatnonzero((lcp < half) & (prev >= 0))
            chars = np.full(len(index), cap, np.int64)
            a, b, k = prev[known], index[known], lcp[known].astype(np.int64)
            first, last = kinds - 1 - names[a + k].astype(np.int64), kinds - 1 - names[b + k].astype(np.int64)
            chars[known] = _extend(text, starts[a], starts[b], starts[a + k] - starts[a] + least(first + 1, last), cap)
            if prev[0] < 0:
                chars[0] = 0
            pos = starts[index]
            out.add(text[pos], pos, chars)
    return falling_run(*out.arrays())


def _doubled(names: np.ndarray, cap: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`falling` for a short string of names, by prefix doubling; the ranks by 1, 2, 4 … names (in files) give
    the common prefixes."""
    n = len(names)
    ranks, order = [mapped(folder, "i4", n + 1)], None
    ranks[0][:n] = names + 1
    while True:
        step = 1 << (len(ranks) - 1)
        rank = ranks[-1]
        key = rank[:n].astype(np.int64) << 32
        if step < n:
            key[: n - step] |= rank[step:n]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(_heads(key), dtype=np.int32)
        del key
        if new[-1] == n or 2 * step >= cap:
            break
        ranks.append(mapped(folder, "i4", n + 1))
        ranks[-1][order] = new
    before = -1
    for a in range(0, n, PART):
        b = order[::-1][a : a + PART]
        a_ = _before(before, b)
        x, y = np.where(a_ < 0, b, a_), b.copy()
        lcp = np.zeros(len(b), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if k == len(ranks) - 1 else 1):
                same = np.flatnonzero((ranks[k][np.minimum(x + lcp, n)] == ranks[k][np.minimum(y + lcp, n)]) & (np.maximum(x, y) + lcp < n))
                lcp[same] += 1 << k
        lcp = np.minimum(lcp, cap)
        if before < 0:
            lcp[0] = 0
        yield b, lcp.astype(np.int32)
        before = int(b[-1])


def falling(text: np.ndarray, symbols: int, cap: int, folder: str, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``text`` in falling order: (positions, common prefix with the suffix before, up to cap).

    The text ends in a 0, the smallest symbol, after a larger one; symbols are below ``symbols``. Suffixes that agree
    in ``cap`` symbols may come in any order.
    """
    if len(text) < 2:
        yield np.arange(len(text)), np.zeros(len(text), np.int32)
        return
    cap = min(cap, len(text))
    starts = _starts(text, folder)
    seeds = Queue(folder, memory, [_sorted_starts(text, starts, symbols, cap, folder, memory)])
    for pos, lcp, _ in _induce(text, seeds, symbols, cap, folder, memory, False):
        yield pos, lcp


def suffix_array(text: np.ndarray, cap: int = 1 << 30, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(positions in rising order, common prefix of each with the one before it) of bytes followed by a sentinel."""
    with tempfile.TemporaryDirectory() as folder:
        parts = [(np.array(p), np.array(x)) for p, x in falling(np.r_[text.astype(np.int16) + 1, 0].astype(np.int16), 257, cap, folder, memory)]
    pos = np.concatenate([p for p, _ in parts])[::-1]
    follow = np.concatenate([x for _, x in parts])[::-1]
    lcp = np.r_[0, follow[:-1]]
    keep = pos < len(text)
    return pos[keep], lcp[keep]
