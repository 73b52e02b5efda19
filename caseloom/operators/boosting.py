"""Multiclass gradient boosting with sparse histogram trees and a softmax objective.

Values of a feature are put in bins at their quantiles; absent values have no bin and go the way that gains more. In a
round each class gets a tree, grown level by level for all classes together: tasks add up gradients and Hessians by
(class, node, feature, bin) over the present values, the sums are added by feature in a shuffle, absent values
get what is left of the node's sum, and each task offers the best split of each node over its features. The driver picks
among a row for each task and node. Where files of the shared folder can be mapped, nothing is shuffled: tasks write gradients
and nodes of their rows, and the task of some features reads these and its part of the entries of all blocks. A feature whose present values weigh too little for a child of a node can split neither
that node nor one below it, so a level has cells for the bins of the other features of each node only; for the root they are
weighed first. A node too light for two children has none.

The rows' scores are written once in ``SETTLED`` rounds; trees grown since then and the present ones are applied on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.blocks import DIRECT, Block, Blocks, Kept, add_up, entries_of, in_place, mapped

SETTLED = 10  # rounds
ROWS_AT_ONCE = 512  # that are spread out over the features a forest asks for
GAIN_FLOOR = 1e-6
SPARSE = 6  # possible keys for each entry up to which sums stand in a plain array
CELLS = 8_000_000  # of a level's sums that a task holds as a plain array, all classes together
SLACK = 1 - 1e-9  # of a least weight that was added up in another order


@dataclass
class Forest:
    """Trees as heaps: the children of node i are 2 i + 1 and 2 i + 2. ``feature`` is -1 at leaves."""

    feature: np.ndarray  # [tree, node]
    limit: np.ndarray  # a present value up to it goes left
    absent_left: np.ndarray
    leaf: np.ndarray
    cover: np.ndarray  # sum of Hessians of the training rows at each node

    @classmethod
    def empty(cls, trees: int, depth: int) -> Forest:
        shape = (trees, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, "i4"), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape))

    @classmethod
    def joined(cls, forests: list[Forest]) -> Forest:
        return cls(*(np.concatenate([getattr(f, n) for f in forests]) for n in cls.__dataclass_fields__))

    def spread(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of the features asked for, NaN where absent, and the column of each feature."""
        asked = np.unique(self.feature[self.feature >= 0])
        column = np.full(width, -1, "i4")
        column[asked] = np.arange(len(asked), dtype="i4")
        rows = np.repeat(np.arange(n), np.diff(np.append(starts, len(idx))))
        at = column[idx]
        out = np.full((n, len(asked) + 1), np.nan)
        out[rows[at >= 0], at[at >= 0]] = val[at >= 0]
        return out, column

    def nodes(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, width: int) -> np.ndarray:
        """The node [row, tree] at which each row ends."""
        values, column = self.spread(starts, idx, val, n, width)
        trees = np.arange(len(self.feature))
        node = np.zeros((n, len(trees)), "i4")
        for _ in range(int(np.log2(self.feature.shape[1] + 1)) - 1):
            feature = self.feature[trees, node]
            value = values[np.arange(n)[:, None], column[np.maximum(feature, 0)]]
            left = np.where(np.isnan(value), self.absent_left[trees, node], value <= self.limit[trees, node])
            node = np.where(feature >= 0, 2 * node + np.where(left, 1, 2), node)
        return node

    def scores(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, width: int, k: int) -> np.ndarray:
        """Sums of leaves [row, class]; tree t adds to class t modulo ``k``."""
        out = np.zeros((n, k))
        if not len(self.feature):
            return out
        trees = np.arange(len(self.feature))
        for a in range(0, n, ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, n)
            first, stop = int(starts[a]), int(starts[b]) if b < n else len(idx)
            node = self.nodes(starts[a:b] - first, idx[first:stop], val[first:stop], b - a, width)
            out[a:b] = self.leaf[trees, node].reshape(b - a, -1, k).sum(axis=1)
        return out


def quantile_edges(df: DataFrame, width: int, bins: int, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """(offsets, edges): upper bounds of the bins of each feature but the last, at quantiles of its present values."""
    rows = df.select(*entries_of(features)).select(F.explode(F.arrays_zip("idx", "val")).alias("e")).filter("e.val <> 0")
    shares = [i / bins for i in range(1, bins)]
    cut = rows.groupBy("e.idx").agg(F.array_distinct(F.percentile_approx("e.val", shares, 100 * bins)).alias("edges"))
    offsets, found = np.zeros(width + 1, "i8"), {}
    for row in cut.toLocalIterator():  # at most bins - 1 numbers for each feature of the model
        found[row["idx"]] = row["edges"]
        offsets[row["idx"] + 1] = len(row["edges"])
    edges = np.array([v for i in sorted(found) for v in sorted(found[i])], "f8")
    return np.cumsum(offsets), edges


def binned(idx: np.ndarray, val: np.ndarray, offsets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each present value: how many edges of its feature lie below it."""
    out = np.zeros(len(idx), "i8")
    for a in range(0, len(idx), 100_000):
        low, high = offsets[idx[a : a + 100_000]], offsets[idx[a : a + 100_000] + 1]
        v = val[a : a + 100_000]
        first = low.copy()
        while (low < high).any():
            middle = (low + high) // 2
            below = (low < high) & (edges[np.minimum(middle, len(edges) - 1)] < v)
            high = np.where((low < high) & ~below, middle, high)
            low = np.where(below, middle + 1, low)
        out[a : a + 100_000] = low - first
    return out


class Binned:
    """Entries by row (starts, idx, bin), and their rows by feature and bin, which are the keys."""

    def __init__(self, names: list[str], values: list):
        self.n = values[0]
        for name, value in zip(names[1:], values[1:], strict=True):
            kind = "i8" if name in ("starts", "key_starts") else "i4" if name in ("idx", "bin", "rows", "key_feature", "key_bin") else "f8"
            setattr(self, name, np.frombuffer(value, kind))


    def part(self, first: int, stop: int) -> Binned:
        """Entries by key of the features from ``first`` up to ``stop``, which are numbered from 0."""
        a, b = np.searchsorted(self.key_feature, [first, stop])
        begin, end = (int(self.key_starts[i]) if i < len(self.key_starts) else len(self.rows) for i in (a, b))
        out = Binned(["n"], [self.n])
        out.rows, out.key_starts = self.rows[begin:end], self.key_starts[a:b] - begin
        out.key_feature, out.key_bin = self.key_feature[a:b] - first, self.key_bin[a:b]
        return out


NAMES = ["n", "starts", "idx", "bin", "rows", "key_starts", "key_feature", "key_bin", "y", "w", "score"]
BINNED = "n int, " + ", ".join(f"{c} binary" for c in NAMES[1:])


def binned_arrays(block: Block, offsets: np.ndarray, edges: np.ndarray, k: int) -> list[np.ndarray]:
    """What a ``Binned`` holds, for a block of ``Blocks``."""
    by_row = binned(block.idx, block.val, offsets, edges)
    keys = offsets[block.idx] + block.idx + by_row
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, "i8")
    rows = np.repeat(np.arange(block.n, dtype="i4"), np.diff(np.append(block.starts, len(block.idx))))
    by_row = by_row.astype("i4")
    return [block.starts, block.idx, by_row, rows[order], first.astype("i8"), block.idx[order][first], by_row[order][first], block.y, block.w, np.zeros(block.n * k)]


def batch_of_block(n: int, arrays: list) -> pa.RecordBatch:
    values = [pa.array([a.to_pybytes() if isinstance(a, pa.Buffer) else a.tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *values], names=NAMES)


def _gradients(block: Binned, state: dict) -> tuple[np.ndarray, np.ndarray]:
    score = block.score.reshape(block.n, -1) + state["since"].scores(block.starts, block.idx, block.bin, block.n, state["width"], state["k"])
    e = np.exp(score - score.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    g = p * block.w[:, None]
    g[np.arange(block.n), block.y.astype("i8")] -= block.w
    return g, np.maximum(2.0 * p * (1.0 - p), 1e-16) * block.w[:, None]


def feature_weights(block: Binned, state: dict) -> np.ndarray:
    """Hessians of the present values of each [class, feature]."""
    _, h = _gradients(block, state)
    out = np.zeros((state["k"], state["width"]))
    if len(block.rows):
        new = np.flatnonzero(np.append(True, block.key_feature[1:] != block.key_feature[:-1]))
        for c in range(state["k"]):
            out[c, block.key_feature[new]] = np.add.reduceat(h[:, c].take(block.rows), block.key_starts[new])
    return out.ravel()


class Cells:
    """Where the sums of a class stand: by chunk of features, then node, feature and bin, for the features ``alive`` [node, feature]."""

    def __init__(self, alive: np.ndarray, bins: np.ndarray, chunks: int):
        m, width = alive.shape
        self.cuts = np.arange(chunks + 1) * width // chunks
        self.base = np.full((m + 1, width), -1, "i8")  # of a (node, feature); the last node is for rows in none
        self.bounds = np.zeros(chunks + 1, "i8")
        for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            size = np.where(alive[:, a:b], bins[a:b], 0)
            ends = np.cumsum(size).reshape(size.shape)
            self.base[:m, a:b] = np.where(size > 0, self.bounds[i] + ends - size, -1)
            self.bounds[i + 1] = self.bounds[i] + size.sum()
        self.some = alive.any(axis=0)

    def places(self, block: Binned, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and row of each entry that has a cell; ``node`` is that of each row."""
        counts = np.diff(np.append(block.key_starts, len(block.rows)))
        asked = self.some[block.key_feature]
        rows, feature, bins = block.rows, block.key_feature, block.key_bin
        if not asked.all():
            rows, feature, bins, counts = rows[np.repeat(asked, counts)], feature[asked], bins[asked], counts[asked]
        width = self.base.shape[1]
        cell = self.base.ravel().take(node.take(rows) * width + np.repeat(feature, counts))
        there = cell >= 0
        cell += np.repeat(bins, counts)
        return (cell, rows) if there.all() else (cell[there], rows[there])


def nodes_and_sums(block: Binned, state: dict, g: np.ndarray, h: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node of a level, ``m`` where a row is in no open one; gradients as real and Hessians as imaginary parts), both [class, row].

    The sums are added to ``totals`` [class, node].
    """
    m = state["m"]
    node = state["growing"].nodes(block.starts, block.idx, block.bin, block.n, state["width"]).astype("i8") - state["first"]
    node = np.ascontiguousarray(np.where((node >= 0) & (node < m), node, m).T)
    both = np.ascontiguousarray((g + 1j * h).T)
    for c in range(state["k"]):
        node[c] = np.where(np.append(state["open"][c], False)[node[c]], node[c], m)
        here = node[c] < m
        np.add.at(totals[c], node[c][here], both[c][here])
    return node, both


def level_sums(
    block: Binned, node: np.ndarray, both: np.ndarray, cells: list[Cells], dense: list[np.ndarray | None], parts: list[list]
) -> None:
    """Adds a block's sums of both to each class's cells; a class without a plain array in ``dense`` gets keys with both sums in ``parts``."""
    for c in range(len(cells)):
        cell, rows = cells[c].places(block, node[c])
        values = both[c].take(rows)
        if dense[c] is not None:
            np.add.at(dense[c], cell, values)
        elif len(cell):
            parts[c].append(sums_by_key(cell, None, 0, 1, values.real, values.imag))


def sums_by_key(
    rank: np.ndarray, names: np.ndarray | None, node: np.ndarray | int, m: int, g: np.ndarray, h: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (name times ``m`` plus node, ascending) with sums of both; ``rank`` is the place in ``names`` of each entry, or the name itself."""
    code = rank * m + node
    if names is None:
        codes, back = np.unique(code, return_inverse=True)
        return codes, np.bincount(back, g, len(codes)), np.bincount(back, h, len(codes))
    size = len(names) * m
    if size <= SPARSE * len(code):
        there = np.zeros(size, bool)
        there[code] = True
        codes = np.flatnonzero(there)
        return names[codes // m] * m + codes % m, np.bincount(code, g, size)[codes], np.bincount(code, h, size)[codes]
    codes, back = np.unique(code, return_inverse=True)
    return names[codes // m] * m + codes % m, np.bincount(back, g, len(codes)), np.bincount(back, h, len(codes))


def best_splits(
    totals: np.ndarray, sums: np.ndarray, alive: np.ndarray, bins: np.ndarray, ridge: float, least: float
) -> tuple[list[tuple], np.ndarray]:
    """For each node of a class the best (node, gain, feature, bin, absent left, g left, h left), and which features are heavy enough.

    ``sums`` are the cells of the features ``alive`` [node, feature] of a chunk, ``totals`` those of the nodes.
    """
    heavy = np.zeros(alive.shape, bool)
    pairs = np.flatnonzero(alive)
    size = bins[pairs % alive.shape[1]]
    there = np.flatnonzero(sums.imag > 0)  # bins without a value split as the one before
    if not len(there):
        return [], heavy
    ends = np.cumsum(size)
    pair = np.searchsorted(ends, there, "right")
    node, feature = np.divmod(pairs[pair], alive.shape[1])
    bin_ = there - (ends - size)[pair]
    g, h = sums.real[there], sums.imag[there]
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    size = np.diff(np.append(new, len(there)))

    def running(x):
        total = np.cumsum(x)
        return total - np.repeat(total[new] - x[new], size)

    gl, hl = running(g), running(h)
    last = new + size - 1
    heavy[node[new], feature[new]] = hl[last] >= least * SLACK
    g_all, h_all = totals.real[node], totals.imag[node]
    g_absent, h_absent = g_all - np.repeat(gl[last], size), h_all - np.repeat(hl[last], size)
    whole = g_all**2 / (h_all + ridge)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    each = np.diff(np.append(first, len(node)))
    best: dict[int, tuple] = {}
    for absent_left in (False, True):
        a, b = (gl + g_absent, hl + h_absent) if absent_left else (gl, hl)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = a**2 / (b + ridge) + (g_all - a) ** 2 / (h_all - b + ridge) - whole
        gain = np.where((b >= least) & (h_all - b >= least), gain, -np.inf)
        top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), each))
        for i in top[np.append(True, node[top[1:]] != node[top[:-1]])].tolist():  # the smallest feature and bin of a node
            if gain[i] > GAIN_FLOOR:
                split = (int(node[i]), float(gain[i]), int(feature[i]), int(bin_[i]), absent_left, float(a[i]), float(b[i]))
                if split[0] not in best or better(split, best[split[0]]):
                    best[split[0]] = split
    return list(best.values()), heavy


def better(a: tuple, b: tuple) -> bool:
    """The larger gain, then the smaller feature and bin, then absent values to the right."""
    return (-a[1], a[2], a[3], a[4]) < (-b[1], b[2], b[3], b[4])


SUMS = "chunk int, cls int, cells binary, sums binary, totals binary"
OFFER = "chunk int, cls int, node int, gain double, feature int, bin int, absent_left boolean, g double, h double, heavy binary, totals binary"


def offered(
    chunk: int, c: int, totals: np.ndarray, sums: np.ndarray, alive: np.ndarray, bins: np.ndarray, first: int, ridge: float, least: float
) -> list[tuple]:
    """Rows of a chunk of features, which begin at ``first``: the heavy ones and the totals, and the best split of each node."""
    splits, heavy = best_splits(totals, sums, alive, bins, ridge, least)
    rest = [(chunk, c, node, gain, int(first) + feature, *others, None, None) for node, gain, feature, *others in splits]
    return [(chunk, c, -1, None, None, None, None, None, None, np.packbits(heavy).tobytes(), totals.tobytes()), *rest]


class Grower:
    def __init__(self, blocks: Blocks, k: int, offsets: np.ndarray, edges: np.ndarray, depth: int, step: float, ridge: float, least: float):
        self.k, self.offsets, self.edges = k, offsets, edges
        self.depth, self.step, self.ridge, self.least = depth, step, ridge, least
        self.width, self.parts = blocks.width, blocks.parts
        self.spark = blocks.kept.sparkSession
        self.chunks = min(self.parts, 64, self.width)
        bins = self.spark.sparkContext.broadcast((offsets, edges))  # as large as the features times the bins
        names = blocks.names

        def run(batches):
            for values in in_place(batches):
                yield batch_of_block(values[0], binned_arrays(Block(names, values), *bins.value, k))

        self.kept = Kept(blocks.kept, run, BINNED, "binned")
        if self.kept.folder is not None:
            bins.destroy()

    def level(self, state: dict) -> tuple[dict[tuple[int, int], tuple], np.ndarray, np.ndarray]:
        """The best split of each (class, node), heavy features [class, node, feature], and totals [class, node]."""
        if self.kept.folder is not None and self.parts > 1:
            return self.mapped_level(state)
        k, m, chunks, width = self.k, state["m"], self.chunks, self.width
        ridge, least = self.ridge, self.least
        bins = np.diff(self.offsets) + 1
        # the features of each class and node, as bits
        shared = self.spark.sparkContext.broadcast({**state, "bins": bins, "alive": np.packbits(state["alive"])})

        def given():
            state = shared.value
            alive = np.unpackbits(state["alive"], count=k * m * width).reshape(k, m, width).view(bool)
            return state, alive, [Cells(alive[c], state["bins"], chunks) for c in range(k)]

        def sums(batches):
            state, _, cells = given()
            totals, parts = np.zeros((k, m), "c16"), [[] for _ in range(k)]
            ends = np.cumsum([c.bounds[-1] for c in cells])
            dense = [np.zeros(c.bounds[-1], "c16") if end <= CELLS else None for c, end in zip(cells, ends, strict=True)]
            for values in in_place(batches):
                block = Binned(NAMES, values)
                level_sums(block, *nodes_and_sums(block, state, *_gradients(block, state), totals), cells, dense, parts)
            for c in range(k):
                bounds = cells[c].bounds
                if dense[c] is None:
                    keys, g, h = added(parts[c])
                    parts[c], both = [], g + 1j * h
                    cuts = np.searchsorted(keys, bounds)
                rows = []
                for chunk in range(chunks):
                    a, b = bounds[chunk], bounds[chunk + 1]
                    if dense[c] is None:
                        part = slice(cuts[chunk], cuts[chunk + 1])
                        there, values = keys[part] - a, both[part]
                    else:
                        values = dense[c][a:b]
                        there = np.flatnonzero(values.imag)
                        values = values[there] if 2 * len(there) < b - a else values
                    place = b"" if len(values) == b - a else there.astype("i4").tobytes()
                    rows.append((chunk, c, place, values.tobytes(), totals[c].tobytes()))
                yield batch_of(rows, SUMS)

        def offers(batches):
            _, alive, cells = given()
            held: dict[tuple, list] = {}
            for batch in batches:
                for chunk, c, place, values, of_nodes in zip(*batch.columns, strict=True):
                    chunk, c = chunk.as_py(), c.as_py()
                    here = held.setdefault((chunk, c), [np.zeros(cells[c].bounds[chunk + 1] - cells[c].bounds[chunk], "c16"), np.zeros(m, "c16")])
                    values, place = np.frombuffer(values.as_buffer(), "c16"), np.frombuffer(place.as_buffer(), "i4")
                    if len(place):
                        here[0][place] += values
                    elif len(values):
                        here[0] += values
                    here[1] += np.frombuffer(of_nodes.as_buffer(), "c16")
            rows = []
            for (chunk, c), (values, totals) in held.items():
                first, stop = cells[c].cuts[chunk], cells[c].cuts[chunk + 1]
                rows += offered(chunk, c, totals, values, alive[c][:, first:stop], shared.value["bins"][first:stop], first, ridge, least)
            yield batch_of(rows, OFFER)

        if self.parts > 1:
            made = self.kept.map(sums, SUMS).repartition(chunks, "chunk").mapInArrow(offers, OFFER)
        else:
            made = self.kept.map(lambda batches: offers(sums(batches)), OFFER)
        found = self.chosen(made, m)
        shared.destroy()
        return found

    def chosen(self, made: DataFrame, m: int) -> tuple[dict[tuple[int, int], tuple], np.ndarray, np.ndarray]:
        k, width, chunks = self.k, self.width, self.chunks
        best: dict[tuple[int, int], tuple] = {}
        heavy, totals = np.zeros((k, m, width), bool), np.zeros((k, m), "c16")
        cuts = np.arange(chunks + 1) * width // chunks
        for row in made.collect():  # a row for each task, class and node
            if row["node"] < 0:
                a, b = cuts[row["chunk"]], cuts[row["chunk"] + 1]
                bits = np.frombuffer(row["heavy"], "u1")
                heavy[row["cls"], :, a:b] = np.unpackbits(bits, count=m * (b - a)).reshape(m, b - a)
                totals[row["cls"]] = np.frombuffer(row["totals"], "c16")  # the same in each
                continue
            split = (row["node"], row["gain"], row["feature"], row["bin"], row["absent_left"], row["g"], row["h"])
            place = (row["cls"], row["node"])
            if place not in best or better(split, best[place]):
                best[place] = split
        return best, heavy, totals

    def mapped_level(self, state: dict) -> tuple[dict[tuple[int, int], tuple], np.ndarray, np.ndarray]:
        """The same from files: tasks of rows write nodes and gradients, tasks of features add up."""
        k, m, chunks, width = self.k, state["m"], self.chunks, self.width
        ridge, least, paths = self.ridge, self.least, self.kept.paths
        of_rows = self.spark.sparkContext.broadcast({n: v for n, v in state.items() if n != "alive"})

        def rows_of(batches):
            state, totals = of_rows.value, np.zeros((k, m), "c16")
            for values in in_place(batches):
                block = Binned(NAMES, values)
                node, both = nodes_and_sums(block, state, *_gradients(block, state), totals)
                yield pa.RecordBatch.from_arrays([pa.array([block.n], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (node, both))], names=["n", "node", "both"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (np.zeros(0), totals))], names=["n", "node", "both"])

        rows = Kept(self.kept, rows_of, "n int, node binary, both binary", "gradients")
        pairs = list(zip(paths, rows.paths, strict=True))
        of_rows.destroy()
        bins, cuts = np.diff(self.offsets) + 1, np.arange(chunks + 1) * width // chunks
        given = self.spark.sparkContext.broadcast({"bins": bins, "alive": np.packbits(state["alive"])})

        def offers(batches):
            alive = np.unpackbits(given.value["alive"], count=k * m * width).reshape(k, m, width).view(bool)
            for chunk in (i for batch in batches for i in batch.column(0).to_pylist()):
                first, stop = cuts[chunk], cuts[chunk + 1]
                own, own_bins, totals = alive[:, :, first:stop], given.value["bins"][first:stop], np.zeros((k, m), "c16")
                for c in range(k):  # one class at a time, so that cells of one are held
                    cells = Cells(own[c], own_bins, 1)
                    sums = np.zeros(cells.bounds[-1], "c16")
                    totals[c] = 0
                    for path, beside in pairs:
                        blocks = in_place(mapped(path))
                        for n, node, both in in_place(mapped(beside)):
                            both = np.frombuffer(both, "c16").reshape(k, -1)[c]
                            if n < 0:
                                totals[c] += both
                                continue
                            block = Binned(NAMES, next(blocks)).part(first, stop)
                            level_sums(block, [np.frombuffer(node, "i8").reshape(k, -1)[c]], [both], [cells], [sums], [[]])
                    yield batch_of(offered(chunk, c, totals[c], sums, own[c], own_bins, first, ridge, least), OFFER)

        found = self.chosen(self.spark.range(0, chunks, 1, chunks).mapInArrow(offers, OFFER), m)
        given.destroy()
        rows.release()
        return found

    def round(self, since: Forest) -> Forest:
        """One tree for each class; limits are bins."""
        k = self.k
        trees = Forest.empty(k, self.depth)
        alive = np.ones((k, 1, self.width), bool)
        if self.parts > DIRECT:  # less is sent where light features are known
            state = {"since": since, "k": k, "width": self.width}
            weights = add_up(self.kept, self.parts, lambda values: Binned(NAMES, values), feature_weights, state, k * self.width)
            alive[:, 0] = weights.reshape(k, self.width) >= self.least * SLACK
        open_ = np.ones((k, 1), bool)
        sums = np.zeros((k, trees.feature.shape[1], 2))
        for d in range(self.depth):
            m, first = 2**d, 2**d - 1
            state = {"since": since, "growing": trees, "k": k, "m": m, "first": first, "width": self.width, "alive": alive, "open": open_}
            best, heavy, totals = self.level(state)
            if d == 0:
                sums[:, 0] = np.stack([totals[:, 0].real, totals[:, 0].imag], axis=1)
            alive, open_ = np.zeros((k, 2 * m, self.width), bool), np.zeros((k, 2 * m), bool)
            for (c, node), (_, _, feature, bin_, absent_left, g, h) in best.items():
                at = first + node
                trees.feature[c, at], trees.limit[c, at], trees.absent_left[c, at] = feature, bin_, absent_left
                sums[c, 2 * at + 1] = g, h
                sums[c, 2 * at + 2] = sums[c, at] - (g, h)
                for side in (0, 1):
                    if sums[c, 2 * at + 1 + side, 1] >= 2 * self.least * SLACK:
                        open_[c, 2 * node + side] = True
                        alive[c, 2 * node + side] = heavy[c, node]
            if not open_.any():
                break
        trees.cover = sums[:, :, 1]
        trees.leaf = np.where(trees.feature < 0, -self.step * sums[:, :, 0] / (sums[:, :, 1] + self.ridge), 0.0)
        return trees

    def settled(self, since: Forest) -> None:
        """Adds the trees to the written scores."""
        k, width = self.k, self.width
        shared = self.spark.sparkContext.broadcast(since)

        def run(batches):
            for values in in_place(batches):
                block = Binned(NAMES, values)
                score = block.score + shared.value.scores(block.starts, block.idx, block.bin, block.n, width, k).ravel()
                yield batch_of_block(values[0], [*values[1:-1], score])

        old = self.kept
        self.kept = Kept(old, run, BINNED, "boosted")
        old.release()

    def limits(self, forest: Forest) -> Forest:
        """The forest with values of features for bins."""
        feature, bins = np.maximum(forest.feature, 0), forest.limit.astype("i8")
        at, stop = self.offsets[feature] + bins, self.offsets[feature + 1]
        padded = np.append(self.edges, np.inf)
        forest.limit = np.where((forest.feature >= 0) & (at < stop), padded[np.minimum(at, len(self.edges))], np.inf)
        return forest


def added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by key, keys ascending."""
    if not parts:
        return np.zeros(0, "i8"), np.zeros(0), np.zeros(0)
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")  # merges the ascending runs
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    place = np.cumsum(new) - 1
    return keys[new], *(np.bincount(place, np.concatenate([p[i] for p in parts])[order], int(new.sum())) for i in (1, 2))


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def boost(
    df: DataFrame, blocks: Blocks, k: int, rounds: int, depth: int, step: float, bins: int, ridge: float = 1.0, least: float = 1.0
) -> Forest:
    """``rounds`` times ``k`` trees for rows packed in ``blocks`` (with y and w) of ``df``.

    ``least`` is the sum of Hessians that a child must have, ``ridge`` the penalty on leaves.
    """
    offsets, edges = quantile_edges(df, blocks.width, bins)
    grower = Grower(blocks, k, offsets, edges, depth, step, ridge, least)
    done, since = [], []
    for _ in range(rounds):
        since.append(grower.round(Forest.joined([Forest.empty(0, depth), *since])))
        if len(since) == SETTLED:
            grower.settled(Forest.joined(since))
            done, since = done + since, []
    grower.kept.release()
    return grower.limits(Forest.joined([Forest.empty(0, depth), *done, *since]))
