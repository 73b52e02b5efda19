"""Windows of a sequence, gathered in fragments that equal windows share.

A window is ``length`` consecutive symbols (bytes or words). Its anchor is the leftmost of the ``k``-symbol pieces in it
with the smallest hash, and it keeps the larger side of the anchor as its context, so about half of it. Consecutive
windows with the same anchor and side form a fragment. Equal windows have equal anchors at the same place and equal
contexts, wherever they stand; so only fragments with the same context can hold equal windows. Contexts are a small part
of the windows in number, and those seen once settle all their windows without looking at them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PLACE_BITS = 24  # of an anchor's sort key: the place in the piece of text at hand
PIECE = 1 << 18  # symbols handled at a time; pieces share length - 1 symbols
U8 = np.uint64
BASES = (U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F))  # odd


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each number over all 64 bits."""
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U8(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U8)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            steps = np.full(size, self.base, U8)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = [Powers(b) for b in BASES]


class Hashed:
    """Hashes of any ranges of a sequence, from sums of its symbols times powers of a base."""

    def __init__(self, symbols: np.ndarray, which: int):
        self.up, self.down = _POWERS[which].to(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, U8)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.sums[1:])

    def ranges(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[first]) * self.down[first] + (stop - first).astype(U8))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours: minima from both ends of blocks of ``w``."""
    n = len(x)
    whole = np.full(-(-n // w) * w, np.iinfo(U8).max, U8)
    whole[:n] = x
    blocks = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


@dataclass
class Fragments:
    """Column by column: sequence number in the batch, first window, number of windows, hash of context and of text."""

    owner: np.ndarray
    first: np.ndarray
    n: np.ndarray
    context: np.ndarray
    text: np.ndarray


def fragments(symbols: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int, k: int) -> Fragments:
    """Fragments of sequences laid end to end; ``owner`` and ``place`` tell for each symbol whose it is and where."""
    n = len(symbols) - length + 1
    none = np.array([], "i8")
    if n <= 0:
        return Fragments(none, none, none, none, none)
    one, two = Hashed(symbols, 0), Hashed(symbols, 1)
    whole = owner[:n] == owner[length - 1 :]  # windows inside one sequence
    keys = one.every(k) & ~U8((1 << PLACE_BITS) - 1) | np.arange(len(symbols) - k + 1, dtype=U8)
    anchor = (sliding_min(keys, length - k + 1)[:n] & U8((1 << PLACE_BITS) - 1)).astype("i8")
    side = (length - k + 1) // 2
    left = anchor - np.arange(n) >= side
    starts = np.flatnonzero(whole)
    if not len(starts):
        return Fragments(none, none, none, none, none)
    a, le, ow = anchor[starts], left[starts], owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (le[1:] != le[:-1]) | (ow[1:] != ow[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, a, le = starts[at], a[at], le[at]
    low = np.where(le, a - side, a)
    high = np.where(le, a + k, a + length - side + 1)
    context = one.ranges(low, high) ^ le.astype(U8)
    text = two.ranges(first, first + count - 1 + length) + (a - first).astype(U8)
    return Fragments(owner[first], place[first], count, context.view("i8"), text.view("i8"))


def batches_of(sequences, length: int, size: int = PIECE):
    """Sequences (arrays) laid end to end in batches of about ``size`` symbols; longer ones in overlapping pieces."""
    parts, owners, places, held = [], [], [], 0
    for number, seq in enumerate(sequences):
        for start in range(0, max(len(seq) - length + 1, 0), size):
            piece = seq[start : start + size + length - 1]
            parts.append(piece)
            owners.append(np.full(len(piece), number, "i4"))
            places.append(np.arange(start, start + len(piece)))
            held += len(piece)
            if held >= size:
                yield np.concatenate(parts), np.concatenate(owners), np.concatenate(places)
                parts, owners, places, held = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(owners), np.concatenate(places)
