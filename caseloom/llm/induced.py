"""External induced suffix sorting with common-prefix values.

Suffixes smaller than their successor are S-type, the others L-type; S suffixes after an L are S*. S* substrings are
sorted by a first induction and named, S* suffixes are ranked on the names, and a second induction sorts all suffixes:
upwards for L, downwards for S. Each queue holds the suffixes of one first symbol as tuples (position, common prefix with
the one before) in order of arrival, which is their order of rank, and so the queues together are a priority queue.
Tuples beyond a bound of memory lie on disk until they are read. When a suffix induces the one to its left, the common
prefix of that one is one more than the least since its queue was last served.

Common prefixes are kept up to a bound, the window length; order beyond it does not matter here.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

import numpy as np

from caseloom.llm.fragments import Hashed

CHUNK = 1 << 17  # tuples handled at a time
RAM_TUPLES = 1 << 23  # tuples that one sort keeps in memory
RAM_ARRAY = 1 << 26  # larger arrays are mapped to files
NONE = np.array([], "i8")


def array(n: int, kind: str) -> np.ndarray:
    """An array of zeros, in a file that goes with it if it is large."""
    if n * np.dtype(kind).itemsize <= RAM_ARRAY:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


@dataclass
class Spill:
    """Tuples in memory over all queues, and the file behind them."""

    held: int = 0
    file: object = None

    def write(self, a: np.ndarray) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(a).tobytes())
        return at

    def read(self, at: int, n: int, kind) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)


@dataclass
class Queue:
    """Tuples in order of arrival; blocks are arrays, or (place, size) where they lie on disk."""

    spill: Spill
    blocks: list = field(default_factory=list)

    def push(self, at: np.ndarray, prefix: np.ndarray) -> None:
        if self.spill.held + len(at) > RAM_TUPLES:
            self.blocks.append((self.spill.write(at), self.spill.write(prefix), len(at)))
        else:
            self.spill.held += len(at)
            self.blocks.append((at, prefix))

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.blocks[k]
        if len(b) == 2:
            return b
        return self.spill.read(b[0], b[2], "i8"), self.spill.read(b[1], b[2], "u2")

    def arriving(self):
        """Blocks in order, joined to larger ones, those that arrive meanwhile included."""
        k = 0
        while k < len(self.blocks):
            parts = [self.block(k)]
            k += 1
            size = len(parts[0][0])
            while k < len(self.blocks) and size < CHUNK:
                parts.append(self.block(k))
                size += len(parts[-1][0])
                k += 1
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def backwards(self):
        for k in range(len(self.blocks) - 1, -1, -1):
            at, prefix = self.block(k)
            yield at[::-1], prefix[::-1]


class Serving:
    """Deals induced suffixes to the queues, with their common prefixes."""

    def __init__(self, symbols: int, bound: int):
        self.bound = bound
        self.low = np.full(symbols, bound, "u2")  # least common prefix scanned since a queue was served
        self.served = np.zeros(symbols, bool)

    def deal(self, queues: dict[int, Queue], spill: Spill, at: np.ndarray, symbol: np.ndarray, keep: np.ndarray, prefix: np.ndarray) -> None:
        """``at``: induced positions, one for each scanned suffix; ``prefix``: common prefixes of the scanned ones."""
        chosen = np.flatnonzero(keep)
        if len(chosen):
            order = np.argsort(symbol[chosen], kind="stable")
            chosen = chosen[order]
            c = symbol[chosen]
            first = np.append(True, c[1:] != c[:-1])
            lead = np.flatnonzero(first)
            before = np.append(-1, chosen[:-1])
            before[first] = -1
            least = range_min(prefix, before + 1, chosen)
            least[lead] = np.minimum(least[lead], self.low[c[lead]])
            value = np.minimum(least.astype("i4") + 1, self.bound).astype("u2")
            value[lead[~self.served[c[lead]]]] = 0
            stops = np.append(lead[1:], len(chosen))
            for a, b in zip(lead.tolist(), stops.tolist(), strict=True):
                s = int(c[a])
                if s not in queues:
                    queues[s] = Queue(spill)
                queues[s].push(at[chosen[a:b]], value[a:b])
        np.minimum(self.low, prefix.min(), out=self.low)
        if len(chosen):
            rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.bound)
            ends = chosen[stops - 1]
            self.low[c[lead]] = rest[ends + 1]
            self.served[c[lead]] = True


def range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of x[first..last] (both included) for each range, from minima over powers of two."""
    size = last - first + 1
    level = np.frexp(size.astype("f8"))[1] - 1
    out = np.empty(len(first), x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of suffixes a[k] and b[k], read off the text, up to ``bound``."""
    out = np.zeros(len(a), "u2")
    n = len(text)
    for start in range(0, len(a), CHUNK):
        live = np.arange(start, min(start + CHUNK, len(a)))
        step, done = 4, 0
        while len(live) and done < bound:
            step = min(step * 2, 64, bound - done)
            i = a[live][:, None] + (done + np.arange(step))
            j = b[live][:, None] + (done + np.arange(step))
            over = np.maximum(i, j) >= n
            same = (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]) & ~over
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[live] += run.astype("u2")
            live = live[run == step]
            done += step
    return out


def types_of(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the last one is S."""
    n = len(text)
    out = array(n, "?")
    out[n - 1] = True
    after = True
    for stop in range(n - 1, 0, -CHUNK * 8):
        start = max(stop - CHUNK * 8, 0)
        a, b = text[start:stop], text[start + 1 : stop + 1]
        less, equal = a < b, a == b
        place = np.where(equal, len(a), np.arange(len(a)))  # the next place to the right where the order is decided
        place = np.minimum.accumulate(place[::-1])[::-1]
        decided = np.append(less, after)
        out[start:stop] = decided[place]
        after = bool(out[start])
    return out


class InducedSort:
    """Sorts the suffixes of ``text`` (symbols below ``symbols``; the last one is 0 and not after a 0) and tells which have a neighbour in
    order with ``bound`` common symbols."""

    def __init__(self, text: np.ndarray, symbols: int, bound: int):
        self.text, self.symbols, self.bound = text, symbols, bound
        self.s_type = types_of(text)
        self.star = array(len(text), "?")
        self.star[1:] = self.s_type[1:] & ~self.s_type[:-1]

    def stars_in_order(self) -> np.ndarray:
        """S* positions in the order of their suffixes, as far as ``bound`` symbols decide."""
        places = np.flatnonzero(self.star)
        sorted_stars: list[np.ndarray] = []
        self._induce(self._by_symbol(places), None, lambda at: sorted_stars.append(at[self.star[at]]))
        order = np.concatenate([*sorted_stars, NONE])[::-1].astype("i8")
        if self.star[len(self.text) - 1]:
            order = np.append(len(self.text) - 1, order)  # the end is not induced and comes first
        rank = np.empty(len(places), "i8")
        rank[np.searchsorted(places, order)] = self._names(order, places)
        return places[self._ranked(rank)]

    def _names(self, order: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Numbers for the S* substrings, equal for equal ones, in the given order."""
        stop = np.append(places[1:] + 1, len(self.text))
        length = stop[np.searchsorted(places, order)] - order
        hashed = Hashed(self.text.astype("u8") + np.uint64(1), 0)
        h = hashed.ranges(order, order + length)
        return np.cumsum(np.append(0, (h[1:] != h[:-1]) | (length[1:] != length[:-1])))

    def _ranked(self, names: np.ndarray) -> np.ndarray:
        """Order of the suffixes of the reduced string; doubling ends where ``bound`` symbols are covered."""
        rank, step, n = names, 1, len(names)
        while True:
            order = np.argsort(rank, kind="stable")
            if step > self.bound or n < 2 or rank[order[-1]] == n - 1:
                return order
            ahead = np.full(n, -1, "i8")
            ahead[: max(n - step, 0)] = rank[step:]
            order = np.lexsort((ahead, rank))
            r, a = rank[order], ahead[order]
            new = np.empty(n, "i8")
            new[order] = np.cumsum(np.append(0, (r[1:] != r[:-1]) | (a[1:] != a[:-1])))
            rank, step = new, 2 * step

    def _by_symbol(self, places: np.ndarray, prefix: np.ndarray | None = None) -> dict[int, tuple]:
        c = self.text[places]
        order = np.argsort(c, kind="stable")
        places, c = places[order], c[order]
        prefix = np.zeros(len(places), "u2") if prefix is None else prefix[order]
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else []
        stops = np.append(cuts[1:], len(c)) if len(c) else []
        return {int(c[a]): (places[a:b], prefix[a:b]) for a, b in zip(cuts, stops, strict=True)}

    def repeated(self) -> np.ndarray:
        """True where a suffix shares ``bound`` symbols with another."""
        hit = array(len(self.text), "?")
        stars = self.stars_in_order()
        prefix = np.zeros(len(stars), "u2")
        if len(stars) > 1:
            prefix[1:] = common_prefix(self.text, stars[:-1], stars[1:], self.bound)
        self._induce(self._by_symbol(stars, prefix), hit, None)
        return hit

    def _induce(self, seeds: dict[int, tuple], hit: np.ndarray | None, on_s) -> None:
        text, bound = self.text, self.bound
        with_prefix = hit is not None
        spill = Spill()
        upper: dict[int, Queue] = {}
        serving = Serving(self.symbols, bound)
        present = np.flatnonzero(np.bincount(text, minlength=self.symbols)).tolist()

        def mark(at, prefix, before):
            """Neighbours in order that share enough; ``before`` is the position scanned before at[0]."""
            if with_prefix:
                k = np.flatnonzero(prefix >= bound)
                if len(k):
                    hit[at[k]] = True
                    hit[np.where(k > 0, at[k - 1], before)] = True

        def seam(a, b):
            return int(common_prefix(text, np.array([a]), np.array([b]), bound)[0]) if with_prefix else 0

        last_l: dict[int, int] = {}
        for c in present:
            before = -1
            if c in upper:
                for at, prefix in upper[c].arriving():
                    mark(at, prefix, before)
                    left = at - 1
                    symbol = text[left].astype("i8")
                    serving.deal(upper, spill, left, symbol, (left >= 0) & (symbol >= c), prefix)
                    before = int(at[-1])
                last_l[c] = before
            if c in seeds:
                at, prefix = seeds[c]
                prefix = prefix.copy()
                prefix[0] = seam(before, int(at[0])) if before >= 0 else 0
                for start in range(0, len(at), CHUNK):
                    left = at[start : start + CHUNK] - 1
                    symbol = text[left].astype("i8")
                    serving.deal(upper, spill, left, symbol, np.ones(len(left), bool), prefix[start : start + CHUNK])
        lower: dict[int, Queue] = {}
        serving = Serving(self.symbols, bound)
        for c in reversed(present):
            before = -1
            if c in lower:
                for at, prefix in lower[c].arriving():
                    mark(at, prefix, before)
                    if on_s is not None:
                        on_s(at)
                    left = at - 1
                    symbol = text[left].astype("i8")
                    serving.deal(lower, spill, left, symbol, (left >= 0) & (symbol <= c), prefix)
                    before = int(at[-1])
            if c in upper:
                carried = seam(before, last_l[c]) if before >= 0 else 0
                if with_prefix and carried >= bound:
                    hit[before] = hit[last_l[c]] = True
                for at, prefix in upper[c].backwards():
                    shifted = np.append(np.array([carried], "u2"), prefix[:-1])
                    carried = int(prefix[-1])
                    left = at - 1
                    symbol = text[left].astype("i8")
                    serving.deal(lower, spill, left, symbol, (left >= 0) & (symbol < c), shifted)
